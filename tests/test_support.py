"""Tokens of a plan that no source supports: digits of two scripts, spellings of names, fractions and times."""

import random
import re

import duckdb

from kymo.operators import plan

from .test_arrays_of_words import query

CASES = [  # text of a block, text of its source, tokens without support
    ("year 1923", "year منذ ١٩٢٣", 0),
    ("منذ ١٩٢٣ و1923", "since 1924", 1),
    ("open SharePoint and Teams", "افتح شير بوينت open", 1),
    ("Forms and Form", "الفورمز", 0),
    ("Forms", "فورم", 1),
    ("teams", "تيم", 1),
    ("costs 3.5 or 3,5", "costs 3.5", 1),
    ("version 3.5", "version 3 and 5", 1),
    ("version 3", "version 3.5", 1),
    ("at 00:12:30 and 1:23 2:34 ٠١:٢٣ open", "open", 0),
    ("ratio 16:9 code x12:30", "ratio code 16", 3),
    ("12:30:4:56 12:34:56:78 1:23", "none", 1),
    ("12:30", "12", None),
]


def test_cases_and_sql(spark):
    q = query(plan, "unsupported_tokens")
    want = sorted((k, n) for k, (_, _, n) in enumerate(CASES) if n is not None)
    blocks, docs = [(k, 0, said) for k, (said, _, _) in enumerate(CASES)], [(k, seen) for k, (_, seen, _) in enumerate(CASES)]
    assert both(spark, q, blocks, docs) == (want, want)


def both(spark, q, blocks, docs):
    ours = q.on(spark, plan_blocks=spark.createDataFrame(blocks, "plan_id long, block_idx int, text string"), documents=spark.createDataFrame(docs, "doc_id long, text string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE plan_blocks (plan_id BIGINT, block_idx INT, text VARCHAR); CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO plan_blocks VALUES (?, ?, ?)", blocks)
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return sorted(tuple(r) for r in ours.collect()), sorted(con.sql(q.sql).fetchall())


def model(blocks, docs):
    fold = str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789")
    tokens = lambda text: {x.lower().translate(fold) for x in re.findall("[A-Za-z]{4,}|[0-9٠-٩]+(?:[.,][0-9٠-٩]+)?", text)}
    said, seen = {}, {}
    for k, _, text in blocks:
        said.setdefault(k, set()).update(tokens(re.sub(r"\b\d{1,2}:\d{2}(?::\d{2})?\b", " ", text)))
    for k, text in docs:
        seen.setdefault(k, set()).update(tokens(text), {name for name, of in plan.ALIASES.items() if any(x in text for x in of)})
    return sorted((k, len(of - seen.get(k, set()))) for k, of in said.items() if of)


def test_random_texts(spark):
    rng = random.Random(7)
    parts = ["1", "12", "٣", "٤٥", ":", ":", ".", ",", " ", "é", "ع", "_", "teams", "Link", "لينك", "تيمز", "\n", "-"]
    text = lambda n: "".join(rng.choice(parts) for _ in range(n))
    blocks, docs = [(k // 2, k % 2, text(40)) for k in range(600)], [(k, text(30)) for k in range(250)]
    want = model(blocks, docs)
    assert both(spark, query(plan, "unsupported_tokens"), blocks, docs) == (want, want)
