"""Text / Markdown / JSON reports."""
import json

import pytest

from codeweave.plans import report as X


def test_invalid_level_rejected(sample_index):
    with pytest.raises(ValueError):
        X.file_blocks(sample_index, "everything")


def test_levels(sample_index):
    def block(level, **kw):
        return X.file_blocks(sample_index, level, **kw).where("path = 'app/service.py'").first().block

    s = block("estructura")
    assert "[app/service.py]" in s and "  class Client" in s and "  fn async main()" in s
    assert "imports:" not in s and "-> llama" not in s
    f = block("firmas")
    assert "  imports: 4" in f and "  class Client(Base, mixins.Loggable)" in f
    assert '    "A client for the service."' in f and "-> llama" not in f
    assert "  var TIMEOUT: int = 30" in f
    c = block("completo")
    assert "      -> llama: self.session.get, resp.json" in c
    assert "     -> llama: os.path.join" in c


def test_markdown_report_order_and_errors(sample_index):
    lines = (X.report_lines(sample_index, "firmas", fmt="md")
             .orderBy("repo", "part", "path", "line_no").collect())
    text = [r.text for r in lines]
    assert text[0].startswith("# codeweave") and text[2].startswith("**Nivel:** firmas")
    heads = [t for t in text if t.startswith("## `")]
    assert heads == sorted(heads)
    assert any(t.startswith("> ⚠ Error: SyntaxError") for t in text)


def test_text_sink(sample_index, tmp_path):
    out = str(tmp_path / "rep")
    X.write_report(X.report_lines(sample_index, "estructura"), out)
    import glob
    body = "".join(open(f).read() for f in sorted(glob.glob(out + "/repo=demo/part-*")))
    assert body.startswith("# codeweave — demo\n# Nivel: estructura\n")
    assert body.index("[app/geometry.cpp]") < body.index("[app/service.py]")


def test_json_documents(sample_index):
    doc = json.loads(X.file_json(sample_index).where("path = 'app/widgets.dart'").first().json)
    assert [c["name"] for c in doc["classes"]] == ["Status", "Loggable", "NumberParsing", "Panel"]
    assert doc["imports"][0]["names"] == ["Widget", "BuildContext"]
