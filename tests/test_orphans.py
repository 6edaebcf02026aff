import random
from datetime import datetime, timedelta

import pytest

from conftest import rows
from pagewright.operators import orphans

T0 = datetime(2025, 1, 1)
C = "concept_id bigint, doc_id string, name string, prerequisites array<string>, loaded_at timestamp, deleted_at timestamp, extra_col string"
V = "verification_id bigint, doc_id string, concept string, checked_at timestamp"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def brute(cs, vs):
    def canon(x):
        return "".join(ch for ch in (x or "").lower() if ch.isalnum())

    targets = [(d, canon(n), a, b) for _, d, n, _, a, b, _ in cs if canon(n) and a and d]
    refs = [("concepts", i, k, d, canon(p), a) for i, d, _, ps, a, _, _ in cs for k, p in enumerate(ps or [])]
    refs += [("verification", i, 0, d, canon(n), t) for i, d, n, t in vs]
    return sorted((s, i, k) for s, i, k, d, c, t in refs if c and not any(
        d == e and c == n and t is not None and a <= t and (b is None or b > t) for e, n, a, b in targets))


@pytest.mark.parametrize("hot", [False, True])
def test_brute_force(spark, hot):
    rng = random.Random(7)
    names = ["Net", "n e t", "Cube", "CUBE!", "sum", "", None, "--", "ghost", "Zed"]
    pick = (lambda: "Net" if rng.random() < .4 else rng.choice(names)) if hot else (lambda: rng.choice(names))
    cs = [(i, rng.choice(["A", "A", "B", None]), pick(), rng.choice([None, [], [pick(), pick()]]), day(rng.choice([None, *range(120)])), None, "x") for i in range(300)]
    cs = [(*r[:5], r[4] + timedelta(days=rng.choice([-1, 0, 3, 40])) if r[4] and rng.random() < .8 else None, r[6]) for r in cs]
    vs = [(i, rng.choice(["A", "B", None]), pick(), day(rng.choice([None, *range(140)]))) for i in range(200)]
    c, v = spark.createDataFrame(cs, C), spark.createDataFrame(vs, V)
    assert rows(orphans.orphan_rows(c, v)) == sorted(brute(cs, vs), key=repr)
    counted = orphans.orphan_counts(c, v).collect()
    assert sum(r.n_orphans for r in counted) == len(brute(cs, vs))


def test_hot_key_of_many_periods(spark):
    # One key holds nearly all rows; its 1,000 short targets lie a day apart, one of them ends in the year 9999.
    cs = [(i, "A", "Net", ["Net"] if i % 3 else ["Cube"], day(2 * i), day(2 * i + 1), "x") for i in range(1000)]
    cs += [(2000, "A", "Zed", None, day(5), datetime(9999, 12, 31), "x"), (2001, "A", "Cube", ["zed"], day(4), None, "x"), (2002, "A", "Sum", ["zed"], day(5), None, "x")]
    vs = [(i, "A", "NET", day(i % 2100) + timedelta(hours=i % 24)) for i in range(3000)] + [(4000 + i, "A", "net", day(1)) for i in range(500)]
    got = orphans.orphan_rows(spark.createDataFrame(cs, C), spark.createDataFrame(vs, V))
    lines = [(day(2 * i), day(2 * i + 1)) for i in range(1000)]
    want = [("verification", i, 0) for i, _, _, t in vs if not any(a <= t < b for a, b in (lines[k] for k in {min((t - T0).days // 2, 999)}))]
    want += [("concepts", i, 0) for i in (0, )] + [("concepts", 2001, 0)]
    assert rows(got) == sorted(want, key=repr)


def test_empty(spark):
    c, v = spark.createDataFrame([], C), spark.createDataFrame([(1, "D", "x", T0)], V)
    assert rows(orphans.orphan_rows(c, v)) == [("verification", 1, 0)]
    assert orphans.orphan_rows(c, v.filter("false")).count() == 0
