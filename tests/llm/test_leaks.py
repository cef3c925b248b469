import random
import re

import pytest
import pyarrow as pa
from corvane.llm.leaks import build_index, leaked_items, leaked_passages, search_index, split_words, words

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi".split()


def tables(seed=2):
    rng = random.Random(seed)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(WORDS) for _ in range(n))
    items = [(i, text(rng.randint(3, 40))) for i in range(25)] + [(90, None), (91, ""), (None, text(9)), (92, "one two three four")]
    docs = []
    for d in range(150):
        body = text(rng.randint(0, 60))
        if rng.random() < 0.4:
            p = rng.choice(items[:25])[1].upper()
            cut = p.split()[: rng.randint(2, 40)]
            body += " " + "-".join(cut) + " " + text(5)
        docs.append((d, body))
    return docs + [(900, None), (901, ""), (None, text(30)), docs[3], (902, " ".join([items[5][1]] * 400))], items


def runs(text):
    w = re.findall(r"[0-9a-z]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def near_runs(text, wanted, slack):
    """Those of the wanted runs whose words stand in order with at most ``slack`` words between."""
    w = re.findall(r"[0-9a-z]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = set()
    for r in wanted:
        for a in range(len(w)):
            at, k = a, 0
            while at < len(w) and at - a < len(r) + slack and k < len(r):
                k += w[at] == r[k] and (at == a) == (k == 0)
                if at == a and k == 0:
                    break
                at += 1
            if k == len(r):
                found.add(r)
                break
    return found


def brute(docs, items, share=0.25, slack=3):
    out = {}
    for i, p in items:
        for d, t in docs:
            r = runs(p)
            exact = r & runs(t)
            near = near_runs(t, r - exact, slack) if slack else ()
            n, m = len(exact), len(near)
            if i is not None and d is not None and r and n + m >= share * len(r):
                out[i, d] = (len(r), n, m, "exact" if n >= share * len(r) else "near")
    return out


@pytest.mark.parametrize("options", [{}, {"query_bytes": 300}, {"slack": 0}, {"min_share": 1.0}, {"slack": 1, "min_share": 0.6}])
def test_equals_brute_force(spark, options):
    docs, items = tables()
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(*r, 1) for r in items], "item_id long, passage string, doc_id int")
    rows = leaked_passages(d, e, **options).collect()
    found = {(r["item_id"], r["doc_id"]): (r["n_runs"], r["n_exact"], r["n_near"], r["match_kind"]) for r in rows}
    assert found == brute(docs, items, options.get("min_share", 0.25), options.get("slack", 3)) and len(found) == len(rows)


def test_words():
    assert words("Ab_c-9éKZ\n\U0001f600x") == [b"ab", b"c", b"9", b"z", b"x"]
    assert words("") == []


def test_gaps(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = [(1, passage), (2, "one two three four five six seven then eight nine ten"), (3, "ten nine eight seven six five four three two one")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(7, passage)], "item_id long, passage string")
    found = {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in leaked_passages(d, e, min_share=0.1).collect()}
    assert found == {1: (6, 0), 2: (3, 3)}
    assert [tuple(r) for r in leaked_items(leaked_passages(d, e)).collect()] == [(7, 2, 1.0)]


def test_words_put_into_every_run(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    put_in = " ".join(f"{w} x{i}" if i % 3 == 2 else w for i, w in enumerate(passage.split()))
    d = spark.createDataFrame([(1, put_in), (2, put_in.replace("x", "x y z ")), (3, "one two three")], "doc_id long, text string")
    e = spark.createDataFrame([(7, passage)], "item_id long, passage string")
    found = {r["doc_id"]: (r["n_exact"], r["n_near"], r["match_kind"]) for r in leaked_passages(d, e).collect()}
    assert found == {1: (0, 8, "near")}
    assert leaked_passages(d, e, slack=0).count() == 0


def test_split_words():
    texts = pa.array(["xx", "Ab c", None, "", "d-E9", "\u00e9", "f"])[1:]
    found, first = split_words(texts)
    assert found.to_pylist() == ["ab", "c", "d", "e9", "f"] and first.tolist() == [0, 2, 2, 2, 4, 4, 5]
    found, first = split_words(pa.array([None, ""], pa.string()))
    assert len(found) == 0 and first.tolist() == [0, 0, 0]


def test_an_index_answers_other_items_without_the_corpus(spark, tmp_path):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    d.write.parquet(str(tmp_path / "docs"))
    index = build_index(spark.read.parquet(str(tmp_path / "docs")), shard_bytes=500)
    assert index.table.select("shard").distinct().count() > 5
    import shutil

    shutil.rmtree(tmp_path / "docs")
    for some in (items[:10], items[10:]):
        e = spark.createDataFrame(some, "item_id long, passage string")
        rows = search_index(index, e).collect()
        assert {(r["item_id"], r["doc_id"]): (r["n_runs"], r["n_exact"], r["n_near"], r["match_kind"]) for r in rows} == brute(docs, some)


def test_runs_do_not_span_texts(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, "a b c d e")], "doc_id long, text string").coalesce(1)
    e = spark.createDataFrame([(7, "a b c d e")], "item_id long, passage string")
    assert [r["doc_id"] for r in leaked_passages(d, e).collect()] == [3]


def test_empty_tables(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, passage string")
    assert leaked_passages(d.limit(0), e).count() == 0 and leaked_passages(d, e.limit(0)).count() == 0
