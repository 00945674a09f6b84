"""Chat formatting, tokens, token files, packing."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeweave.llm import chat, common, packing, token_files
from codeweave.llm.tokens import Encoder

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def whole(path, text):
    return Encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <| b <|| c"), (1, 1, "user", None), (1, 2, "assistant", "x<|im_end|>"), (1, 3, "assistant", "<"),
            (1, 4, "assistant", "|y"), (1, 5, None, "\nz"), (2, None, "assistant", ""), (None, 0, "us<|im_sep|>er", "q"),
            (1, 2, "assistant", "x<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(turns).select(
        "*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    for conv in (1, 2, None):
        want = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in want]
        assert got[conv]["learned"] == "".join(r[3] or "" for r in want if r[2] == "assistant")
    assert got[1]["formatted"].count("<|im_start|>") == 3  # adjacent turns of a role are one block
    assert chat.format_conversations(turns.where("false")).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_give_the_ids_of_the_whole_text(path):
    rng = random.Random(5)
    e = Encoder(path)
    letters = " \n\t\xa0\x1c\x85ab'sé1.,<|́\x00İΣß²A !%"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 10, 40]))) for _ in range(3000)]
    texts += ["it's I'LL 3.14 ...!? %%% a%%% \n\n b", "<|endoftext|> x", "", None, "x" * 5000]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [
        e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_the_untouched_library(spark, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rng = random.Random(6)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>", " ", "\n", "  ", "Page", " one", ".", "é", "12"]
    texts = ["end of page <|endoftext|> next", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "plain words, only."]
    texts += ["".join(rng.choice(bits) for _ in range(rng.choice([3, 10, 40]))) for _ in range(500)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert any(x in ids for ids in want for x in (49407, 50256))
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path).encode(texts)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(docs, path, 1).collect()}
    assert got == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())) for i, ids in enumerate(want)}


def test_token_files_round_trip(spark, odd, none):
    got = token_files.token_files(odd, WORD, 1).collect()
    rows = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[2])
    assert [r[:2] for r in rows] == sorted((r[:2] for r in rows), key=lambda r: (r[0], r[1] or 0))  # ascending ids
    at = 0
    for _, _, start, n, _ in rows:
        assert start == at
        at += n
    want = sorted((len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
                  for ids in (whole(WORD, r["text"]) for r in odd.collect()))
    assert sorted((r[3], r[4]) for r in rows) == want
    assert token_files.token_files(none, WORD, 1).count() == 0


def test_documents_are_found_from_the_folder_alone(spark, odd, clashing, tmp_path):
    folder = str(tmp_path / "files")  # no scheme: Spark's default file system decides
    assert token_files.qualified(spark, folder) == f"file://{folder}"
    token_files.write_token_files(clashing, WORD, 1, folder)
    for doc_id in (20, 3, 14, 99):
        want = sorted([*whole(WORD, r["text"]), 1] for r in odd.where(F.col("doc_id") == doc_id).collect())
        assert sorted(x.tolist() for x in token_files.find_document(spark, folder, doc_id)) == want
    place = token_files.read_token_files(spark, folder).where("doc_id = 20").first()
    row = token_files.read_manifest(spark, folder).where(F.col("shard") == place["shard"]).first()
    shard = token_files.Shard(f"file://{folder}/{row['file']}", token_files.open_dictionary(f"file://{folder}"))
    assert len(shard.ids(place["place"])) == place["n_tokens"] and row["base"] + shard.ends[place["place"]] == place["start"]
    with pytest.raises(ValueError):
        token_files.Shard(f"file://{folder}/{row['file']}", b"another dictionary")


def test_dictionary_sample_is_bounded_distinct_and_from_anywhere(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 50)
    monkeypatch.setattr(token_files, "SAMPLE_CHARS", 20)
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a copy' ELSE concat(repeat('x', 30), id, repeat('y', 30)) END AS t")
    got = token_files.sample_texts(rows)
    assert 10 < len(got) < 90 and got.count("a copy") == 1  # a third of all rows is one sample
    assert all(len(t) <= 20 for t in got) and any("y" in t for t in got) and any("x" in t for t in got)
    assert token_files.sample_texts(rows.where("false")) == []
    assert token_files.sample_texts(rows.where("t = 'a copy'")) == ["a copy"]


def test_plan_is_feasible_and_tight():
    rng = random.Random(2)
    for size in (0, 1, 40, 3000):
        counts = {}
        for _ in range(size):
            k = min(1024, max(1, int(rng.lognormvariate(5, 1.2))))
            counts[k] = counts.get(k, 0) + 1
        patterns = packing.plan(dict(counts))
        used = {}
        for times, chosen in patterns:
            assert sum(k * v for k, v in chosen.items()) <= 1024
            for k, v in chosen.items():
                used[k] = used.get(k, 0) + v * times
        assert used == counts
        assert sum(t for t, _ in patterns) <= -(-sum(k * v for k, v in counts.items()) // 1024) * 1.01 + 1
    best = max(sum(c) for n in range(1, 5) for c in __import__("itertools").combinations([700, 300, 200, 30, 24], n)
               if sum(c) <= 1024 and 700 in c)
    assert sum(k * v for k, v in packing.fullest({700: 1, 300: 1, 200: 1, 30: 1, 24: 1}, 1024).items()) == best


def test_packing(spark, odd, none):
    rows = packing.pack_documents(odd, BYTE, 2).collect()
    want = []
    for r in odd.collect():
        ids = [*whole(BYTE, r["text"]), 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                 for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none, BYTE, 2).count() == 0


def test_packing_tokenizes_and_counts_in_one_worker(spark, monkeypatch):
    """Two Python steps in a row hold two workers for each core, each with a tokenizer's memory."""
    plans, kept = [], common.store
    monkeypatch.setattr(common, "store", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    docs = spark.createDataFrame([(1, "one text"), (2, None), (3, "another " * 2000)], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack_documents(docs, BYTE, 2).collect()} == {1, 2, 3}
    assert [p.count("MapInArrow") for p in plans] == [1]
