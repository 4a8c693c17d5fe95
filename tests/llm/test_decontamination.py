"""Winnowed decontamination against plain windows over words."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from terrace.llm import winnow

DOCS = "doc_id long, text string, items string, start int, mark long"
ITEMS = "item_id long, text string, length int, h string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = words(text)
        n = min(10, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, met = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                if (found := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    met |= found - {None}
        names = ",".join(sorted(map(str, met)))
        out.append((doc, len(ws), len(hit), len(met), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 3, "h") for i, t in items], ITEMS)
    got = winnow.contamination(d, b, **more)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order(map(tuple, got.collect())) == order(brute(docs, items))


def passages(seed):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.choice((1, 2, 3, 5, 7, 9, 10, 11, 25)))).title()) for i in range(25)]
    docs = []
    for i in range(40):
        ws = [rng.choice(some) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            part = words(rng.choice(items)[1])
            begin = rng.randrange(len(part))
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part[begin : begin + rng.randrange(1, 14)]
        docs.append((i, ", ".join(ws)))
    return docs, items


@pytest.mark.parametrize("limit", [winnow.BROADCAST_ROWS, 0])
def test_contamination_against_all_windows(spark, limit):
    run(spark, *passages(5), limit=limit)


def test_windows_of_ten_only(spark):
    """Nine words in common are none; an edge of one window, overlapping ones, and a hit at either end of a text."""
    item = " ".join(f"t{i}" for i in range(14))
    ws = item.split()
    docs = [(1, " ".join(ws[:9])), (2, " ".join(ws[2:12])), (3, "a " + item + " b"), (4, " ".join(ws[:10] + ["x"] + ws[4:14])), (5, item.upper()), (6, item.replace(" ", ";\n"))]
    run(spark, docs, [(7, item), (10, item), (9, "q")])


def test_odd_documents_and_items(spark):
    long_text = " ".join(f"n{i % 977}" for i in range(30_000))
    same = " ".join(["ba"] * 400)
    docs = [(1, None), (2, ""), (3, " \t.,"), (4, "ba"), (5, "ba ba"), (5, "ba ba"), (6, long_text), (7, same), (None, "É ba Ünder ß日本"), (None, None), (8, "a\u0000b")]
    run(spark, docs, [(1, None), (2, ""), (3, "..."), (None, "ünder"), (4, "BA"), (4, "BA"), (5, same), (6, "n5 n6 n7"), (11, "a b"), (12, "Ünder ß日本")])
    run(spark, docs, [])
    run(spark, [], [(1, "ba")])


def test_a_passage_in_every_item_lists_no_items_twice(spark):
    shared = " ".join(f"p{i}" for i in range(12))
    items = [(i, f"{shared} end{i}") for i in range(200)]
    docs = [(i, f"start{i} {shared} tail") for i in range(150)] + [(900, "p1 p2 p3")]
    run(spark, docs, items)
    windows, members, _ = winnow.benchmark_windows(spark.createDataFrame(items, "item_id long, text string"))
    # Three windows of all items share one set; each of the others has its own.
    assert windows.select("items").distinct().count() == 201 and members.count() == 400
    assert members.groupBy("items").agg(F.count("item").alias("n")).agg(F.max("n")).first()[0] == 200
