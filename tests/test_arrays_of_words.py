"""Words of texts that meet in arrays, one for each text, however rows lie in the table."""

import random
import re

from kymo import fixtures
from kymo.operators import plan, terms

from .test_queries import SF


def query(module, name):
    return next(q for q in module.QUERIES if q.name == name)


def tables(seed, words):
    """Blocks and documents with repeated and null ids, texts and places that come twice, and ids of one side alone."""
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " ", *[rng.choice([" ", "  ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(9)]])
    blocks = [(rng.choice([None, *range(12)]), rng.randrange(9), text()) for _ in range(150)]
    return blocks, [(rng.choice([None, *range(4, 16)]), text()) for _ in range(25)]


def found(spark, q, blocks, docs, parts):
    b = spark.createDataFrame(blocks, "plan_id long, block_idx int, text string").repartition(parts)
    return sorted((tuple(r) for r in q.on(spark, plan_blocks=b, documents=spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)


def exchanges(spark, q):
    shown = q.on(spark, **{name: fixtures.view(spark, SF, name) for name in q.inputs})._jdf.queryExecution().executedPlan().toString()
    return shown.count("Exchange hashpartitioning"), shown.count("Window [")


def glossary(blocks, docs):
    places = {}
    for plan, at, text in blocks:
        for run in re.findall("[A-Za-z]{3,}(?: [A-Za-z]{3,}){1,3}", text or ""):
            places.setdefault(plan, {}).setdefault((1, run.lower()), []).append(at)
    for plan, text in docs:
        for at, word in enumerate(re.sub("[^a-z ]+", " ", (text or "").lower()).split(" "), 1):
            if len(word) > 7:
                places.setdefault(plan, {}).setdefault((2, word), []).append(at)
    out = []
    for plan, of in places.items():
        kept = []
        for origin, _, term in sorted((origin, min(at), term) for (origin, term), at in of.items()):
            if len(kept) < 25 and not any(f" {term} " in f" {t} " for _, t in kept):
                kept.append((origin, term))
        out += [(plan, term, "screen" if origin == 1 else "frequency") for origin, term in kept]
    return sorted(out, key=str)


def test_glossaries_of_odd_rows(spark):
    words = ["Form", "scheduler", "Assignment", "assignments", "der", "of", "x1", "Überprüfung", "frequency", "GLOSSARY", "candidate", "a-b", "lists", "Screens"]
    for seed, parts in ((1, 1), (2, 5), (3, 3)):
        blocks, docs = tables(seed, words)
        assert found(spark, query(terms, "glossary_candidates"), blocks, docs, parts) == glossary(blocks, docs)


def test_a_glossary_moves_an_array_for_each_text(spark):
    assert exchanges(spark, query(terms, "glossary_candidates")) == (1, 0)  # three, and a window, when each word was a row


def unsupported(blocks, docs):
    tokens = lambda text: {x.lower() for x in re.findall("[A-Za-z]{4,}|[0-9]+", text or "")}
    said, seen = {}, {}
    for rows, out in (([(p, t) for p, _, t in blocks], said), (docs, seen)):
        for key, text in rows:
            out.setdefault(key, set()).update(tokens(text))
    return sorted(((key, len(of - (set() if key is None else seen.get(key, set())))) for key, of in said.items() if of), key=str)


def test_unsupported_tokens_of_odd_rows(spark):
    words = ["Form", "form", "FORMS", "x12y", "12", "0", "der", "Überprüfung", "a-b", "lists", *(f"word{chr(97 + k)}" for k in range(26))]
    for seed, parts in ((4, 1), (5, 5), (6, 3)):
        blocks, docs = tables(seed, words)
        blocks += [(99, 0, "a b"), (98, 0, None), (97, 0, "alone 1 alone 1")]  # no token, no text, no document
        assert found(spark, query(plan, "unsupported_tokens"), blocks, docs, parts) == unsupported(blocks, docs)


def test_unsupported_tokens_move_a_row_for_each_text(spark):
    assert exchanges(spark, query(plan, "unsupported_tokens"))[0] == 1
