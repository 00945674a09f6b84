"""Fixed values that must equal the behaviour being matched.

Everything in this module is data, stated plainly and in natural order:
folder names that disqualify a path, the extension → language map, call
names that are never recorded, keywords of each dialect, and the two naming
dictionaries used by the naming-language vote.  Nothing here is computed.
"""

# --- fixed values: path parts that exclude a file (exact, case-sensitive) ---
EXCLUDED_PARTS = [
    "__pycache__", ".git", ".venv", "venv", "env", ".env", "node_modules",
    ".dart_tool", ".idea", ".vscode", "build", "dist", "out", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "coverage", ".coverage", "htmlcov", ".tox",
    "eggs", ".eggs", "*.egg-info",
]

# --- fixed values: lower-cased extension → language code ---
EXTENSIONS = {
    ".py": "python",
    ".dart": "dart",
    ".js": "js",
    ".jsx": "jsx",
    ".ts": "ts",
    ".tsx": "tsx",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
}

JS_LANGS = ["js", "jsx", "ts", "tsx"]
C_LANGS = ["c", "cpp"]

# --- fixed values: call names never recorded (all dialects) ---
EXCLUDED_CALLS = [
    "print", "len", "str", "int", "float", "bool", "list", "dict", "set",
    "tuple", "range", "enumerate", "zip", "map", "filter", "sorted",
    "reversed", "isinstance", "issubclass", "getattr", "setattr", "hasattr",
    "delattr", "callable", "open", "type", "repr", "id", "hash", "abs",
    "round", "min", "max", "sum", "any", "all", "next", "iter", "vars", "dir",
    "help", "super", "object", "property", "staticmethod", "classmethod",
    "if", "for", "while", "return", "yield", "raise", "assert", "del", "pass",
    "break", "continue", "import", "from", "with", "try", "except", "finally",
    "else", "elif", "lambda", "await", "async",
    "console", "require", "define", "include", "sizeof", "typeof",
    "instanceof", "void", "new", "delete", "throw", "catch", "switch", "case",
    "default",
]

# --- fixed values: control-flow words also dropped by the brace dialects ---
CONTROL_FLOW = [
    "if", "for", "while", "switch", "catch", "return", "throw", "new",
    "delete", "typeof", "instanceof", "in", "of", "await", "yield", "import",
    "export", "else", "do", "case", "default", "break", "continue", "void",
    "sizeof", "alignof", "static_assert",
]

BRACE_EXCLUDED_CALLS = sorted(set(EXCLUDED_CALLS) | set(CONTROL_FLOW))

# --- fixed values: JS/TS words that are never member names ---
JS_KEYWORDS = [
    "if", "for", "while", "switch", "catch", "function", "return", "new",
    "typeof", "instanceof", "delete", "void", "throw", "await", "import",
    "export", "class", "extends", "super", "this", "async", "yield",
    "debugger", "case", "default", "constructor",
]

# --- fixed values: C/C++ keywords and base type names ---
C_KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "default", "return",
    "break", "continue", "goto", "sizeof", "alignof", "typedef", "struct",
    "class", "enum", "union", "template", "namespace", "using", "public",
    "private", "protected", "virtual", "static", "extern", "inline", "const",
    "constexpr", "volatile", "override", "final", "new", "delete", "throw",
    "try", "catch", "nullptr", "true", "false", "this",
]
C_BASE_TYPES = [
    "void", "int", "float", "double", "char", "bool", "long", "short",
    "unsigned", "signed", "auto", "size_t", "uint8_t", "uint16_t", "uint32_t",
    "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t", "String", "byte",
]

# --- fixed values: Dart keywords ---
DART_KEYWORDS = [
    "if", "else", "for", "while", "do", "switch", "case", "default", "return",
    "break", "continue", "throw", "try", "catch", "finally", "new", "await",
    "yield", "assert", "in", "is", "as", "super", "this", "null", "true",
    "false", "void", "dynamic", "var", "final", "const", "late", "static",
    "abstract", "override", "async", "sync", "external", "factory", "get",
    "set", "import", "export", "library", "part", "class", "mixin", "enum",
    "extension", "typedef", "with", "implements", "extends", "on", "required",
    "covariant", "sealed", "base", "interface",
]

# --- fixed values: naming dictionaries for the language vote ---
WORDS_ES = [
    "obtener", "establecer", "crear", "eliminar", "actualizar", "buscar",
    "conectar", "desconectar", "iniciar", "detener", "pausar", "reanudar",
    "cargar", "guardar", "enviar", "recibir", "procesar", "validar",
    "calcular", "mostrar", "ocultar", "abrir", "cerrar", "leer", "escribir",
    "agregar", "quitar", "limpiar", "reiniciar", "verificar", "comprobar",
    "convertir", "parsear", "formatear", "imprimir", "registrar", "manejar",
    "cliente", "servidor", "archivo", "carpeta", "indice", "lista", "tabla",
    "usuario", "contrasena", "nombre", "valor", "tipo", "estado", "error",
    "mensaje", "datos", "resultado", "respuesta", "solicitud", "conexion",
    "configuracion", "parametro", "opcion", "modo", "nivel", "limite",
    "tiempo", "fecha", "hora", "numero", "texto", "cadena", "clave",
]
WORDS_EN = [
    "get", "set", "create", "delete", "update", "search", "find",
    "connect", "disconnect", "start", "stop", "pause", "resume",
    "load", "save", "send", "receive", "process", "validate",
    "calculate", "show", "hide", "open", "close", "read", "write",
    "add", "remove", "clear", "reset", "check", "verify",
    "convert", "parse", "format", "print", "log", "handle",
    "client", "server", "file", "folder", "index", "list", "table",
    "user", "password", "name", "value", "type", "status", "error",
    "message", "data", "result", "response", "request", "connection",
    "config", "param", "option", "mode", "level", "limit",
    "time", "date", "number", "text", "string", "key", "manager",
    "handler", "builder", "factory", "parser", "reader", "writer",
]

# --- fixed values: export detail levels ---
REPORT_LEVELS = ["estructura", "firmas", "completo"]

# Value cut applied to some initialisers (JS variables and this.x, C globals
# and defines).
VALUE_CUT = 80
