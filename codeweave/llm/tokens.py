"""Encoding with a public tokenizer, remembering the ids of words met before.

Both supported kinds split a text into pieces before they merge bytes: no piece
crosses from a non-space into white space, nor from a letter into closing
punctuation.  A text may therefore be cut there and each cut part encoded by
itself; the ids of the parts, joined, are the ids of the text.  Parts recur, so
nearly all are looked up.  The memory is bounded: two generations, of which the
older is dropped when the younger is full.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types

from .common import by_value

by_value(__name__)

#: Entries in one generation of the memory, and the longest part that is remembered (characters).
PARTS, LONGEST = 300_000, 40
CLOSING = ".,;:!?%&*$#|"
#: A run of letters before closing punctuation or white space, else all up to the next white space, each with the
#: white space before it; or closing white space.  (The dotted capital I is left out: its lower case ends in a mark.)
_PARTS = re.compile(rf"\s*[^\W\d_İ]+(?=[{CLOSING}\s]|\Z)|\s*\S+|\s+")
#: White space to Python, but not to the tokenizers: such texts are encoded whole.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Texts of these bytes and Latin letters only are cut by plain replacements.
_SIMPLE = b"".join(bytes([c]) for c in range(128) if chr(c).isalnum()) + b" \n" + CLOSING.encode()
_LATIN = re.compile("[À-ÖØ-öø-ÿ]*")
_FOLDED, _WORD = re.compile("[a-zß-öø-ÿ]+"), re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Memory:
    """Two generations of a bounded dictionary: the older is dropped when the younger is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def recall(self, keys: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What the older generation knows of ``keys``, and the others."""
        old = self.old
        found = {k: old[k] for k in keys if k in old}
        return found, [k for k in keys if k not in found]

    def forget_long(self, keys: set[str]) -> None:
        """Long parts are not remembered, as they hardly recur."""
        for k in keys:
            if len(k) > LONGEST:
                self.young.pop(k, None)


class _Packers(dict):
    """Number of ids -> what packs them as little-endian unsigned 32-bit integers."""

    def __missing__(self, n: int):
        self[n] = struct.Struct(f"<{n}I").pack
        return self[n]


class Encoder:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, those of the library with
    ``add_special_tokens=False``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # the library gives their ids for these strings wherever they stand in a text, so a text with one is not cut
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.folds = ids(" A") == ids("a")  # white space dropped, lower case
        # a single word needs no splitting: its bytes, as the vocabulary writes them, go to the model at once
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.model, self.word = self.tokenizer.model, _FOLDED if self.folds else _WORD
        if any(map(self.word.fullmatch, self.added)):  # a word might hold such a token
            self.word = re.compile("(?!)")
        self.spelling = {i: spell(chr(i))[0][0] for i in [32, *range(0xC0, 0x100)]}
        self.memory = Memory(PARTS)

    def parts(self, text: str) -> list[str]:
        """Cut before white space, and before closing punctuation after a letter or digit; whole with an added token."""
        if any(content in text for content in self.added):
            return [text]
        if not _LATIN.fullmatch(text.encode().translate(None, _SIMPLE).decode()) or not self.folds and (
                "  " in text or "\n\n" in text or " \n" in text or "\n " in text):
            return [text] if _SEPARATORS.search(text) else _PARTS.findall(text)
        present = [c for c in CLOSING if c in text]
        for c in present:
            text = text.replace(c, "\x00" + c)
        for c in present:
            for d in present:
                text = text.replace(f"{c}\x00{d}", c + d)
            text = text.replace(f"{c}\x00{c}", c + c)  # runs: every other one is left the first time
        if self.folds:
            return text.lower().replace("\x00", " ").split()
        for c in present:
            text = text.replace(f" \x00{c}", f" {c}")
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def ask(self, parts: list[str]) -> dict[str, bytes]:
        word, tokenize, spelling, found, others = self.word.fullmatch, self.model.tokenize, self.spelling, {}, []
        pack = _Packers()
        for p in parts:
            if word(p):
                ids = [t.id for t in tokenize(p.translate(spelling))]
                found[p] = pack[len(ids)](*ids)
            else:
                others.append(p)
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            found[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.memory.turn()
        cut = [self.parts(t or "") for t in texts]
        young = self.memory.young
        missing = set().union(*cut).difference(young)
        if missing:
            fresh, new = self.memory.recall(missing)
            fresh.update(self.ask(new))
            young.update(fresh)
        get = young.__getitem__
        found = [b"".join(map(get, parts)) for parts in cut]
        self.memory.forget_long(missing)
        return found


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file; it outlives the
    task in a reused worker (task functions travel by value, so it is kept in a
    module entry of its own)."""
    kept = vars(sys.modules.setdefault("codeweave_worker_memory", types.ModuleType("codeweave_worker_memory")))
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
