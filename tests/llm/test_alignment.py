"""Alignment of two tokenizers against whole-text encodings and plain sets, on given and odd texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kymo.llm import alignment, registry

SF = "/root/testdata/sf0.001"


def brute(texts):
    """The contract's columns for each text: whole texts encoded by the libraries, ends as sets."""
    a_side = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    entries = {i: e for e, i in a_side.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    laid, counts = [], Counter()
    for text in texts:
        whole = f" {text or ''}".encode()
        a = a_side.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        left = [bytes(byte_of[c] for c in entries[i]) for i in a]
        right = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(left) != whole or b"".join(right) != whole:
            laid.append(None)
            continue
        ends = [set(_sums(side)) for side in (left, right)]
        groups, i, j, x, y = [], 0, 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            group = ([], [])
            while x < end:
                group[0].append(a[i])
                x += len(left[i])
                i += 1
            while y < end:
                group[1].append(b[j])
                y += len(right[j])
                j += 1
            groups.append(group)
        links = Counter((p, q) for ps, qs in groups for p in ps for q in qs)
        counts.update(links.keys())
        laid.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    for one in laid:
        if one is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, links = one
        text = ";".join(f"{','.join(map(str, ps))}|{','.join(map(str, qs))}" for ps, qs in groups)
        best = sum(m for k, m in links.items() if counts[k] == most[k[0]])
        yield n_a, n_b, len(groups), sum(links.values()), best, sum(m * counts[k] for k, m in links.items()), hashlib.sha256(text.encode()).hexdigest()


def _sums(side):
    total = 0
    for x in side:
        total += len(x)
        yield total


def odd_texts(n):
    rng = random.Random(13)
    letters = [chr(rng.randrange(0x20, 0x3000)) for _ in range(200)] + list("  \n\t\r▁  abcXYZ019.,'<|>\x00\x1c\x85🙂") * 5 + ["<|endoftext|>", "</s>", "<0x0A>"]
    parts = ["a", "the", "x1", "\n", "\t", "\xa0", "  ", "é", "don't", "'s", "\r\n", "ﬁ", "...", ";\r"]
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))).replace("▁", "" if k % 3 else "▁")
        else:
            yield "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 30)))


def columns(df):
    return df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs]), strict=True))
    rows = columns(registry.queries()["op13_alignment"](spark, SF)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(docs)


def test_odd_texts_equal_brute_force(spark):
    texts = [*odd_texts(1500), None, "", " ", "  ", "plain", "plain", "word " * 30_000, "ab" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "pairs", "times", "n", "bytes")})
    got = {r.doc_id: tuple(r)[1:] for r in columns(alignment.compare(df)).collect()}
    want = list(brute(texts))
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) > 20 and sum(w[0] > 0 for w in want) > 500


def test_memory_may_be_forgotten_at_any_time(monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 0)
    texts = list(odd_texts(200))
    one = alignment.Aligner(alignment.BYTE_LEVEL, alignment.PIECES)
    got = [x for k in range(0, 200, 7) for x in one(texts[k : k + 7])]
    monkeypatch.setattr(alignment, "MEMORY", 1 << 30)
    whole = list(alignment.Aligner(alignment.BYTE_LEVEL, alignment.PIECES)(texts))
    assert [(a[0], a[1], a[2].tolist(), a[3].tolist()) for a in got] == [(a[0], a[1], a[2].tolist(), a[3].tolist()) for a in whole]


def test_no_text_is_cut_where_a_vocabulary_has_pieces_over_spaces():
    one = alignment.Aligner(alignment.BYTE_LEVEL, alignment.PIECES)
    assert one.cut and one.units("a b  c\n d ") == ["a", "b", " c\n d "]
    one.cut = False
    assert one.units("a b") == ["a b"] and [x[0] for x in one(["a b"])] == [[2, 2, 2, 2]]


def test_pairs_below_the_share_meet_in_a_shuffle(spark, monkeypatch):
    """With no pair broadcast, and with all of them, the same sums."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = []
    for share in (1, 1 << 40):
        monkeypatch.setattr(alignment, "HOT", share)
        rows.append(sorted(tuple(r) for r in alignment.compare(docs).collect()))
    assert rows[0] == rows[1]


def test_empty_tables_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert alignment.compare(df.limit(0)).count() == 0
    rows = alignment.compare(df).collect()
    assert sorted((r.doc_id is None, r.n_links, r.count_sum) for r in rows) == [(False, 0, 0), (True, 2, 4), (True, 2, 4)]
    named = alignment.compare(df.withColumnRenamed("doc_id", "id").withColumn("id", F.lit("x")), id_col="id")
    assert named.columns[0] == "id" and named.schema["id"].dataType.simpleString() == "string"


def test_pairs_are_read_in_portions_and_the_aligner_goes(monkeypatch):
    monkeypatch.setattr(alignment, "PORTION", 80)
    alignment.aligner(alignment.BYTE_LEVEL, alignment.PIECES)
    raw = [np.arange(n).astype("<i8").tobytes() for n in (3, 0, 30, 1, 1, 9, 2)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(raw, pa.binary())], names=["row", "pairs"])] * 2 + [pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["row", "pairs"])]
    parts = list(alignment.pair_portions(iter(batches), 1))
    assert [r for p in parts for r in p.column(0).to_pylist()] == [*range(8)] * 2 and len(parts) > 6
    sizes = [[len(x or b"") for x in p.column(1).to_pylist()] for p in parts]
    assert all(sum(x) - max(x, default=0) < 80 for x in sizes)
    assert alignment.aligner.cache_info().currsize == 0
