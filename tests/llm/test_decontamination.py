"""Slot-consistent runs against all intervals, and the word sieve against hashing whole texts."""

import random

import numpy as np
import pytest

from respan.llm import decontamination as D
from tests.conftest import SF_SMALL


def token(x) -> bytes:
    return str(x).encode().rjust(8, b"_")


def windows_of(item, doc, slots, width=4):
    """Hits of all windows whose literal tokens agree."""
    out = []
    for p in range(len(item) - width + 1):
        span = range(p, p + width)
        if all(slots[i] or item[i] == doc[i] for i in span):
            out.append((p, width, b"".join(token(doc[i]) for i in span), b"".join(token(item[i]) for i in span),
                        bytes(slots[i] for i in span)))
    return out


def longest_interval(hits, item, doc, slots):
    """All intervals: covered by windows, one-to-one slots."""
    covered = {p + j for p, width, *_ in hits for j in range(width)}
    best = 0
    for a in range(len(item)):
        for b in range(a + 1, len(item) + 1):
            if not all(i in covered for i in range(a, b)):
                break
            pairs = {(item[i], doc[i]) for i in range(a, b) if slots[i]}
            if len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
                best = max(best, b - a)
    return best


def test_longest_run_is_the_best_of_all_intervals():
    rng = random.Random(9)
    found = set()
    for _ in range(600):
        n = rng.randint(1, 30)
        slots = [rng.random() < 0.4 for _ in range(n)]
        item = [rng.randint(0, 3) if s else f"w{rng.randint(0, 9)}" for s in slots]
        became = {v: rng.randint(0, 3) for v in range(4)}
        doc = [(became[x] if rng.random() < 0.9 else rng.randint(0, 3)) if s else (x if rng.random() < 0.95 else "other")
               for x, s in zip(item, slots, strict=True)]
        hits = windows_of(item, doc, slots)
        rng.shuffle(hits)
        assert D.longest_run(hits) == longest_interval(hits, item, doc, slots)
        found.add(D.longest_run(hits))
    assert len(found) > 15


PROBE = "take 7 ships carry grain past sunken tall grey towers before dawn 7 sleep under falling snow"
ITEMS = [(1, PROBE), (2, "Anna has $12. Ben has $15. How many coins do Anna and Ben carry home together today?"),
         (3, "What is the tallest tower"), (4, "A 20-year-old car drives 5km and 3 miles north before the old bridge falls down")]


def leaked(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.tokens) for r in D.leaks(docs, bench).collect())


def test_a_run_goes_on_past_the_slot_that_disagrees(spark):
    changed = PROBE.replace("7", "8", 1).replace("dawn 7", "dawn 9")
    tail = " ".join(changed.split()[2:])
    got = leaked(spark, [(10, changed), (11, "lead words " + tail + " more"), (12, changed.replace("grain", "stone"))], ITEMS)
    assert got == [(10, 1, 15), (11, 1, 15)]


@pytest.mark.parametrize("repeat", [1, 3])
def test_the_word_sieve_changes_nothing(spark, monkeypatch, repeat):
    rng = random.Random(repeat)
    rows = [(i, t) for i, t in enumerate(r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())]
    items = ITEMS + [(100 + r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for k in range(60):
        _, t = rng.choice(items)
        words = t.split()
        for _ in range(rng.randint(0, 3)):  # other numbers and names, some other words
            j = rng.randrange(len(words))
            words[j] = rng.choice(["9", "17km", "20-year-old", "Zoe", "zzunknown", "$4", "Max."])
        rows.append((5000 + k, " ".join([rng.choice(["Lead", "lead.", "12"]), *words, rng.choice(["tail", "5"])] * repeat)))
    some = leaked(spark, rows, items)
    monkeypatch.setattr(D, "_words_bitmap", lambda _: np.full(1 << (D.BITS - 6), ~np.uint64(0)))
    assert some == leaked(spark, rows, items) and len(some) > 30
