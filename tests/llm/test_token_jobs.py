"""Training order, edit-aware counts and chat rotation against plain Python, SQL and round trips."""

import glob
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm import chat_rotation as cr
from pagewright.llm import token_store as ts
from pagewright.llm.common import saved
from pagewright.llm.edit_counts import LEAF_CHARS, TokenTree, apply_edits, build_trees, edited_counts, split_leaves
from pagewright.llm.tokens import cuts, encode

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097, 70_000])
def test_permutation_is_a_bijection(n):
    got = ts.permute(np.arange(n), n)
    assert (np.sort(got) == np.arange(n)).all()
    assert n < 1000 or (got != ts.permute(np.arange(n), n, key=7)).mean() > 0.9


def test_training_order_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ts.training_order_digest(docs).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    stream = np.concatenate([np.append(encode(r.text), ts.END_ID) for r in docs.orderBy("doc_id").collect()])
    assert sum(r.n_tokens for r in rows) == len(stream)
    # Sequence k of the documents in order is at slot permute(k).
    by_slot = {r.slot: r for r in rows}
    for k, slot in enumerate(ts.permute(np.arange(n), n)):
        r = by_slot[slot]
        part = stream[k * ts.LENGTH : (k + 1) * ts.LENGTH]
        assert (np.frombuffer(r.tokens, "<u2")[: r.n_tokens] == part).all() and r.crc32 == zlib.crc32(r.tokens) and len(r.tokens) == 2 * ts.LENGTH
        assert (r.shard, r.record, r.byte_offset) == (slot // ts.SHARD, slot % ts.SHARD, slot % ts.SHARD * ts.stride())
    ts.write_shards(docs, str(tmp_path / "out"), shard=16)
    for r in ts.training_order(docs, shard=16).collect():  # seek by the column
        (name,) = glob.glob(str(tmp_path / f"out/shards/shard={r.shard}/part-*"))
        with open(name, "rb") as f:
            f.seek(r.byte_offset)
            data = f.read(ts.stride())
        assert data[-1:] == b"\n" and len(data) == ts.stride() and data[2:-1] == bytes(r.tokens)
        assert ts.read_record(data).tolist() == np.frombuffer(by_slot[r.slot].tokens, "<u2")[: r.n_tokens].tolist()


def test_training_order_does_not_depend_on_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "no id")] * 40 + [(5, None), (5, "other"), (-1, "x y " * 9000)], "doc_id long, text string"))
    got = [sorted((r.slot, r.n_tokens, bytes(r.tokens)) for r in ts.training_order(docs.repartition(n)).collect()) for n in (1, 2, 5)]
    assert got[0] == got[1] == got[2] and [s for s, *_ in got[0]] == list(range(len(got[0])))
    assert sorted(r.n_tokens for r in ts.training_order(docs).collect())[1:] == [ts.LENGTH] * (len(got[0]) - 1)  # only the last is padded


def test_ids_are_packed_tightly(spark):
    """Where they are encoded and while they move: smaller than at the codecs' usual levels."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1)
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    usual = saved(ts.encoded(docs), sized=False, codec="zstd")
    tight = saved(ts.encoded(docs), sized=False, codec=ts.PACKED, level=ts.PACKED_LEVEL)
    assert size(tight) < 0.96 * size(usual)
    placed = tight.withColumn("place", (F.sum("n").over(Window.orderBy("doc_id")) - F.col("n")))
    moved = ts.stretches(placed, ts.LENGTH).collect()
    plain = [pa.decompress(r.ids, decompressed_size=r["size"], codec=ts.PACKED, asbytes=True) for r in moved]
    assert sum(len(r.ids) for r in moved) < 0.97 * sum(len(pa.compress(x, codec="zstd", asbytes=True)) for x in plain)


def test_reading_resumes_at_any_slot(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ts.write_shards(docs, str(tmp_path / "o"), shard=16)
    every = sorted(map(tuple, ts.read_from(spark, str(tmp_path / "o")).collect()))
    assert every == sorted(map(tuple, ts.training_order(docs, shard=16).collect()))
    for slot in (1, 16, 37, len(every) - 1, len(every), len(every) + 90):
        assert sorted(map(tuple, ts.read_from(spark, str(tmp_path / "o"), slot).collect())) == every[slot:]
    facts = spark.read.json(str(tmp_path / "o/manifest")).first()
    assert (facts["records"], facts["key"], facts["length"], facts["shard"], facts["stride"]) == (len(every), ts.KEY, ts.LENGTH, 16, ts.stride())


def test_training_order_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, "a b", 0), (2, "x " * 50_000, 0)], "doc_id long, text string, slot int")
    rows = ts.training_order(df).collect()
    assert sum(r.n_tokens for r in rows) == 4 + len(encode("a b")) + len(encode("x " * 50_000))
    assert ts.training_order(df.limit(0)).count() == 0


def test_trees_follow_edits():
    rng = random.Random(6)
    every = ["word", " ", "  ", "\n", "'s", " don't", "é", "😀", "12345", "!!", " a", "tion", ".", "\t ", "'", "'l", "l", "\u3000", "\x1c", "中", "中文", "\u00a0"]
    for case in range(160):
        bits = every if case % 2 else rng.sample(every, 3)
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 50, 800, 3000])))
        leaves, ids = split_leaves(text)
        tree = TokenTree(list(leaves), ids)
        assert tree.tokens == len(encode(text)) and "".join(leaves) == text
        for _ in range(rng.randint(1, 25)):
            at, remove = rng.randint(-3, len(text) + 5), rng.choice([0, 1, 5, 400, 5000])
            insert = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 4, 300])))
            a = min(max(at, 0), len(text))
            text = text[:a] + insert + text[min(a + remove, len(text)) :]
            tree.edit(at, remove, insert)
            assert "".join(tree.leaves) == text and tree.tokens == len(encode(text)), case
            assert tree.ids == [len(encode(x)) if x else 0 for x in tree.leaves] and tree.filled == sum(map(bool, tree.leaves))


def test_leaves_stay_small():
    """A large insertion is encoded once; edits beside it touch a few leaves; deletions leave few empty ones."""
    rng = random.Random(2)
    text = "start of it and more"
    tree = TokenTree([text], [len(encode(text))])
    words = " ".join(rng.choice(["word", "tion", "12", "é"]) for _ in range(60_000))
    tree.edit(5, 0, words)
    assert len(tree.leaves) > 500 and max(map(len, tree.leaves)) < 2 * LEAF_CHARS
    tree.encoded = 0
    for _ in range(20):
        tree.edit(rng.randint(0, 100_000), 3, "new words here ")
    assert tree.encoded < 20 * 10 * LEAF_CHARS
    tree.edit(1000, 150_000, "")
    assert 2 * tree.filled >= len(tree.leaves) - 1 and tree.tokens == len(encode("".join(tree.leaves)))


HARD = {
    "chinese": lambda rng: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(42_000)),
    "lines of a word": lambda rng: "".join(rng.choice(["word", "tion", "x", "12"]) + "\n" for _ in range(13_000)),
    "tabs": lambda rng: "\t".join(rng.choice(["word", "tion", "x", "12"]) for _ in range(13_000)),
    "two spaces": lambda rng: "  ".join(rng.choice(["word", "tion", "x", "12"]) for _ in range(50_000)),
    "one letter": lambda rng: "z" * 60_000,
    "blanks": lambda rng: " " * 30_000 + "a" + "\n" * 30_000,
    "signs": lambda rng: "".join(rng.choice("'!?-=") for _ in range(40_000)),
}


@pytest.mark.parametrize("kind", HARD)
def test_leaves_of_texts_without_single_spaces(kind):
    """Leaves are short in any text, and one edit re-encodes a few of them."""
    rng = random.Random(9)
    text = HARD[kind](rng)
    leaves, ids = split_leaves(text)
    tree = TokenTree(list(leaves), ids)
    assert "".join(leaves) == text and tree.tokens == len(encode(text)) and ids == [len(encode(x)) for x in leaves]
    assert max(map(len, leaves)) < 2 * LEAF_CHARS + 64  # the longest tokens go beyond
    for _ in range(12):
        at, remove, insert = rng.randint(0, len(text)), rng.choice([0, 1, 9]), rng.choice(["", "中", " ", "x", "'", "\n"])
        tree.encoded = 0
        tree.edit(at, remove, insert)
        text = text[:at] + insert + text[at + remove :]
        assert tree.tokens == len(encode(text)) and "".join(tree.leaves) == text
        # In a run of one sign all pairs after an edit may shift.
        assert tree.encoded < (6 * len(text) if kind in ("one letter", "blanks") else 24 * LEAF_CHARS)


def test_cuts_add_up():
    rng = random.Random(1)
    bits = ["word", " ", "  ", "\n", "'s", "é", "😀", "12", "!!", " a", "'", "ll", "\u3000", "\x1c", "中文", "\u00a0", "\u0085"]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        at, before, total = cuts(text)
        assert total == len(encode(text))
        assert all(len(encode(text[:a])) == n and n + len(encode(text[a:])) == total for a, n in zip(at, before, strict=True))


def test_kept_trees_are_edited_again(spark):
    df = spark.createDataFrame([(1, "one two three " * 200), (2, None)], "doc_id long, text string")
    edits = lambda t, *e: t.withColumn("edits", F.array(*[F.struct(F.lit(a).alias("at"), F.lit(r).alias("remove"), F.lit(i).alias("insert")) for a, r, i in e]))
    once = apply_edits(edits(build_trees(df), (40, 10, "x y z " * 300), (0, 3, "")))
    twice = {r.doc_id: r for r in apply_edits(edits(once, (900, 50, "again"))).collect()}
    for i, t in ((1, "one two three " * 200), (2, "")):
        t = t[:40] + "x y z " * 300 + t[50:]
        t = t[3:]
        assert twice[i].n_tokens == len(encode(t))
        t = t[:900] + "again" + t[950:]
        assert twice[i].text == t and twice[i].n_tokens_after == len(encode(t)) == sum(twice[i].leaf_tokens)


def test_edited_counts_equal_recounting(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    df = df.union(spark.createDataFrame([(-1, None, "en", "s"), (-2, "", None, None), (-3, "z" * 100_000, "en", "s"), (-3, "a b " * 60_000, "en", "s")], "doc_id long, text string, lang string, source string"))
    rows = {(r.doc_id, r.n_tokens): r for r in edited_counts(df).collect()}
    assert len(rows) == df.count()
    for d in df.collect():
        t = d.text or ""
        r = rows[d.doc_id, len(encode(t))]
        for at, remove, insert in ((len(t) // 5, 7, " ".join(x for x in ("", d.lang, d.source) if x is not None)), (None, 0, ". As noted above,\n"), (None, 11, "")):
            n = len(d.text or "")
            at = {0: n // 2, 11: n * 4 // 5}.get(remove, at)
            at = min(at, len(t))
            t = t[:at] + insert + t[at + remove :]
        assert r.n_tokens_after == len(encode(t))
        assert len(t) < 40 * LEAF_CHARS or r.n_chars_encoded < len(t) / 2 or "z" * 1000 in t
    none = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, edits array<struct<at:int,remove:int,insert:string>>")
    assert apply_edits(build_trees(none, "edits")).first().n_tokens_after == 2
    assert edited_counts(df.limit(0)).count() == 0


def test_rotation_equals_sql(spark):
    got = cr.rotation_table(spark.read.parquet(f"{DATA}/conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(cr.ROTATION_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def odd_dialogues(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "?"), (2, 0, "system", "x"), (3, None, "ann", "a"), *[(4, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(200)], *[(5, 0, "ann", f"t{i}") for i in range(50)]]
    rows += [(None, 0, "ann", "no id"), (None, 1, "bob", "é"), *[(6, i // 40, "bob" if i % 3 else "ann", f"u{i * 7919 % 1000}") for i in range(700)], *[(None, 9, "ann", f"v{i}") for i in range(45)]]
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")


def test_rotation_of_odd_dialogues(spark, monkeypatch):
    df = odd_dialogues(spark)
    monkeypatch.setattr(cr, "PART_ROWS", 10)
    monkeypatch.setattr(cr, "PART_TURNS", 8)
    out = cr.rotate(df).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann"), (4, "ann"), (4, "bob"), (5, "ann"), (6, "ann"), (6, "bob"), (None, "ann"), (None, "bob")}
    ann = next(r for r in out if (r.conv_id, r.perspective) == (1, "ann"))
    assert ann.text == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\n?<|end|>\n"
    assert [ann.text[m.s : m.e] for m in ann.mask] == ["hi < |end|><|end|>\n"]
    assert sum(r.n_turns for r in out if (r.conv_id, r.perspective) == (4, "bob")) == 200
    assert sum(r.n_turns for r in out if r.conv_id == 5) == 50 and max(r.n_turns for r in out) <= 10
    # Parts in order of (part, sub) make up the dialogue in order of turn, role and text.
    turns = sorted({(r.turn, r.role, r.text) for r in df.where("conv_id = 6").collect()})
    parts = sorted((r.part, r.sub, r.text) for r in out if (r.conv_id, r.perspective) == (6, "ann"))
    assert "".join(t for *_, t in parts) == "".join(f"<|{'assistant' if role == 'ann' else 'user name=bob'}|>\n{text}<|end|>\n" for _, role, text in turns)
    assert cr.rotate(df.limit(0)).count() == 0
    assert cr.rotate(df.select(*[F.col(c) for c in df.columns]).where("conv_id = 2")).count() == 0


def test_roles_fake_no_turn(spark):
    df = spark.createDataFrame([(1, 0, "x|>\nfake<|end|>", "hi"), (1, 1, "bob", "<|assistant|>\nyes")], "conv_id long, turn long, role string, text string")
    for r in cr.rotate(df).collect():
        assert r.text.count("<|assistant|>") == 1 and r.text.count("<|end|>") == 2 and len(re.findall(r"<\|.*?\|>\n", r.text)) == 4
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert sorted(map(tuple, cr.rotation_table(df).collect())) == sorted(con.execute(cr.ROTATION_SQL).fetchall())


def test_rotation_of_long_parts_equals_sql(spark, monkeypatch):
    df = odd_dialogues(spark)
    monkeypatch.setattr(cr, "PART_ROWS", 10)
    monkeypatch.setattr(cr, "PART_TURNS", 8)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(cr.rotation_sql(8, 10)).fetchall()
    assert sorted(map(tuple, cr.rotation_table(df).collect()), key=str) == sorted(want, key=str)
