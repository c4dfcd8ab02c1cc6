"""Entity resolution and the sliding limiter against plain Python."""

import random
import re

import pytest

from docketspark.operators import entities, identifiers, limiter, relational

ROSTER = "id string, chamber string, state string, last string, first string, nickname string, party string, seq int"
TERMS = "id string, last string, chamber string, state string, start string, end string, party string, seq int"
ROWS = "n int, id string, chamber string, state string, last string, first string, date string, disclosed string, party string, tier string"


def plain(row, roster, terms):
    """The four tiers, row by row, over lists."""
    chamber, state, day = row[2] or "", (row[3] or "").upper(), row[6] or row[7] or ""
    last = re.sub(r",\s*(jr|sr|ii|iii|iv|v)\.?\s*$", "", (row[4] or "").lower()).strip()
    given = ((row[5] or "").lower().split() or [""])[0]
    current = [r for r in roster if all((r[0], r[1], r[2], r[3]))]
    if not last:
        return None, None
    if state:
        hits = [r for r in sorted(current, key=lambda r: r[7]) if (r[1], r[2].upper(), r[3].lower()) == (chamber, state, last)]
        if hits:
            return hits[-1][0], 1
    if chamber == "senate":
        hits = [r for r in current if r[1] == "senate" and r[3].lower() == last]
        if len(hits) > 1:
            hits = [r for r in hits if given and given in ((r[4] or "").lower(), (r[5] or "").lower())]
        if len(hits) == 1:
            return hits[0][0], 2
    hits = [r for r in current if r[1] == chamber and r[3].lower().split()[-1] == last != r[3].lower() and state in ("", r[2].upper())]
    if len(hits) == 1:
        return hits[0][0], 3
    hits = {(t[0], t[3].upper()) for t in terms if t[2] == chamber and t[1].lower() == last and t[4] and t[5] and t[4] <= day <= t[5] and (t[3].upper() == state or (not state and chamber == "senate"))}
    return (next(iter(hits))[0], 4) if day and len(hits) == 1 else (None, None)


@pytest.mark.parametrize("seed", range(3))
def test_tiers_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    names = ["Smith", "Van Dyke", "dyke", "O'Neil", "De La Cruz", "Cruz", "Ray", "", None]
    day = lambda: f"{rng.randint(1998, 2004)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"
    pick = rng.choice
    roster = [(f"B{k}" if k % 11 else None, pick(["senate", "house"]), pick(["tx", "CA", "ny", None]), pick(names), pick(["Al", "Bo", None]), pick(["Bo", "Cy", "Al", ""]), pick(["D", None]), k) for k in range(14)]
    terms = []
    for k in range(16):
        start = day()
        terms.append((f"H{k % 6}", pick(["Smith", "CRUZ", "Gone", "Long"]), pick(["senate", "house"]), pick(["TX", "ca"]), start, pick([day(), "2003-12-31", f"{int(start[:4]) + 3}-01-01", None]), pick(["R", ""]), k))
    lasts = ["smith", "Smith, Jr.", "DYKE", "Cruz,iii", "Gone", "long", "ray", " ", None, "O'NEIL , sr"]
    rows = [
        (k, "KEEP" if k % 9 == 0 else pick(["", None]), pick(["senate", "house", None]), pick(["", "TX", "ca", None]), pick(lasts), pick(["Al B.", "bo", " CY", "", None]), pick([day(), "", None, "not a day"]), pick([day(), None]), pick(["", "X", None]), "extra")
        for k in range(160)
    ]
    asked = spark.createDataFrame(rows, ROWS).withColumnRenamed("tier", "other")
    got = {r.n: r for r in entities.resolve(asked, spark.createDataFrame(roster, ROSTER), spark.createDataFrame(terms, TERMS)).collect()}
    assert len(got) == len(rows)
    seen = set()
    for row in rows:
        hit, tier = plain(row, roster, terms)
        r = got[row[0]]
        seen.add(tier)
        if row[1]:
            assert (r.id, r.tier, r.party, r.state) == (row[1], None, row[8], row[3])
            continue
        assert (r.id, r.tier) == (hit or "", tier), row
        if hit is None:
            assert (r.party, r.state) == (row[8], row[3])
            continue
        own = [x for x in roster if x[0] == hit and x[1] and x[2] and x[3]] or [x for x in sorted(terms, key=lambda t: t[7]) if x[0] == hit and x[5]][:1]
        party, state = (own[-1][6] or "", own[-1][2].upper()) if hit[0] == "B" else (own[0][6] or "", own[0][3].upper())
        assert (r.party, r.state) == (row[8] or party, row[3] or state)
    assert {1, 2, None} <= seen


def test_every_tier_and_ambiguity(spark):
    roster = [
        ("B1", "senate", "TX", "Cruz", "Ted", "", "R", 1), ("B2", "senate", "NJ", "Booker", "Cory", "", "D", 2), ("B3", "senate", "FL", "Scott", "Rick", "Ricky", "R", 3),
        ("B4", "senate", "SC", "Scott", "Tim", "", "R", 4), ("B5", "house", "TX", "De La Cruz", "Monica", "", "R", 5), ("B6", "house", "TX", "Cruz", "x", "", "D", 6), ("B7", "house", "TX", "Cruz", "y", "", "D", 7),
    ]
    terms = [("H1", "Kyl", "senate", "AZ", "1995-01-03", "2013-01-03", "R", 1), ("H1", "Kyl", "senate", "AZ", "2018-09-05", "2018-12-31", "R", 2), ("H2", "Hall", "house", "TX", "2001-01-03", "2003-01-03", "D", 1), ("H3", "Hall", "house", "TX", "2002-01-03", "2004-01-03", "R", 1)]
    cases = [
        (("senate", "tx", "CRUZ", None, None), ("B1", 1)), (("house", "TX", "Cruz", None, None), ("B7", 1)), (("senate", "", "Booker", None, None), ("B2", 2)),
        (("senate", "", "Scott", "ricky T.", None), ("B3", 2)), (("senate", "", "Scott", "Bob", None), ("", None)), (("senate", "XX", "Scott, Jr.", "Tim", None), ("B4", 2)),
        (("house", "", "Cruz", None, None), ("B5", 3)), (("house", "NY", "cruz", None, None), ("", None)), (("senate", "", "Kyl", None, "2018-10-01"), ("H1", 4)),
        (("senate", "AZ", "Kyl", None, "2015-01-01"), ("", None)), (("house", "TX", "Hall", None, "2002-06-01"), ("", None)), (("house", "TX", "Hall", None, "2003-06-01"), ("H3", 4)),
        (("house", "", "Hall", None, "2003-06-01"), ("", None)), (("senate", "AZ", "Kyl", None, "1995-01-03"), ("H1", 4)),
    ]
    rows = [(k, "", *asked[:4], asked[4], None, "", "x") for k, (asked, _) in enumerate(cases)]
    asked = spark.createDataFrame(rows, ROWS).withColumnRenamed("tier", "other")
    got = {r.n: (r.id, r.tier) for r in entities.resolve(asked, spark.createDataFrame(roster, ROSTER), spark.createDataFrame(terms, TERMS)).collect()}
    assert got == {k: wanted for k, (_, wanted) in enumerate(cases)}
    none = entities.resolve(asked, spark.createDataFrame([], ROSTER), spark.createDataFrame([], TERMS)).collect()
    assert {(r.id, r.tier) for r in none} == {("", None)}


def exact(hits, limit, window):
    kept, out = {}, []
    for client, hit, at in sorted((x for x in hits if x[2] is not None), key=lambda x: (str(x[0]), x[2], x[1])):
        own = [x for x in kept.get(client, []) if x > at - window]
        admitted = len(own) < limit
        kept[client] = own + [at] * admitted
        out.append((client, hit, admitted))
    return sorted(out + [(c, h, False) for c, h, at in hits if at is None], key=str)


@pytest.mark.parametrize(("chunk", "limit", "window"), [(1_000_000, 3, 10), (40, 5, 25), (25, 1, 7), (5, 0, 10)])
def test_limiter_equals_the_fold(spark, monkeypatch, chunk, limit, window):
    monkeypatch.setattr(limiter, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk + limit)
    hits = [("hot", k, rng.randint(-50, 150)) for k in range(300)] + [(rng.choice(["a", "b", None]), 1000 + k, rng.randint(-50, 400)) for k in range(150)] + [("a", 5000, None), ("a", 5001, 3), ("a", 5001, 3)]
    got = limiter.admitted(spark.createDataFrame([(*x, "more") for x in hits], "client string, hit long, at long, run string"), limit, window)
    assert sorted((tuple(r) for r in got.collect()), key=str) == exact(hits, limit, window)


def test_limiter_of_nothing(spark):
    assert limiter.admitted(spark.createDataFrame([], "client string, hit long, at long"), 3, 10).count() == 0


def superseded(rows):
    """The rule row by row: the latest dated row, the earliest's year, the first frame."""
    out = {}
    for key, filed, seq, value, year, frame in sorted(rows, key=lambda r: r[2]):
        filed, held = filed or "", out.get(key)
        if held is None:
            out[key] = {"row": (filed, value, frame), "latest": filed, "year": year, "earliest": filed, "frame": frame}
            continue
        if filed and filed >= held["latest"]:
            held["row"], held["latest"] = (filed, value, frame), filed
        if filed and (not held["earliest"] or filed < held["earliest"]):
            held["year"], held["earliest"] = year, filed
        if not held["frame"] and frame:
            held["frame"] = frame
    return {k: (x["row"][0], x["row"][1], x["year"], x["row"][2] or x["frame"]) for k, x in out.items()}


def test_supersession_equals_the_fold(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40), rng.choice(["", None, "2020-01-01", "2020-02-01", "2019-05-05", "2021-07-07"]), k, rng.random(), rng.randint(2000, 2020), rng.choice(["", None, f"CY{k}"])) for k in range(300)]
    rows += [(99, "", 900, 1.0, 1, ""), (99, None, 901, 2.0, 2, None)]
    got = relational.supersede(spark.createDataFrame(rows, "k int, filed string, seq int, value double, year int, frame string"), ["k"], "filed", "seq", ["year"], ["frame"])
    assert {r.k: (r.filed or "", r.value, r.year, r.frame or "") for r in got.collect()} == {k: (*x[:3], x[3] or "") for k, x in superseded(rows).items()}


def test_identifiers_are_held_against_names(spark):
    holdings = [("I1", "Alpha Corp", 1), ("I1", "Alpha Corp", 2), ("I2", "Beta Intl", 3), ("I3", "Gamma", 4), ("I4", "Delta", 5), (None, "Alpha Corp", 6), ("I6", None, 7), ("I7", "Zeta", 8)]
    by_instrument = [("I1", "ALPHA", "Alpha Corporation"), ("I2", "WRONG", "Other Things"), ("I3", "", "Gamma"), ("I6", "ANY", "Whatever"), ("I7", "W", "Not That")]
    by_name = [("BETA INTERNATIONAL LTD", "BETA.A"), ("Beta International", "BET"), ("Alpha", "ALP"), (None, "NONE")]
    searched = [("Gamma", "GAM", "Gamma Holdings"), ("Delta", "D", "Epsilon"), ("Zeta", "ZETAA", "Zeta Group"), ("Zeta", "ZET", "The Zeta Co")]
    frames = (spark.createDataFrame(holdings, "instrument string, issuer string, ticker0 int"), spark.createDataFrame(by_instrument, "instrument string, ticker string, name string"), spark.createDataFrame(by_name, "name string, ticker string"), spark.createDataFrame(searched, "asked string, ticker string, name string"))
    found = identifiers.validated(*frames)
    got = {r.ticker0: (r.ticker, r.step) for r in found.collect()}
    assert got == {1: ("ALPHA", 1), 2: ("ALPHA", 1), 3: ("BET", 2), 4: ("GAM", 3), 5: ("", None), 6: ("ALP", 2), 7: ("ANY", 1), 8: ("ZET", 3)}
    assert sorted(tuple(r) for r in identifiers.learned(found).collect()) == [("I2", "BET", "Beta Intl", "name_fallback"), ("I3", "GAM", "Gamma", "name_search"), ("I7", "ZET", "Zeta", "name_search")]
    nothing = [f.limit(0) for f in frames[1:]]
    assert {r.step for r in identifiers.validated(frames[0], *nothing).collect()} == {None}


def test_resolution_broadcasts_nothing_that_grows_and_counts_each_entry_of_one_period(spark):
    terms = [("H1", "Ray", "senate", "TX", "2001-01-03", "2003-01-03", "R", 1), ("H2", "Ray", "senate", "CA", "2001-01-03", "2003-01-03", "D", 1), ("H3", "Hall", "house", "TX", "2001-01-03", "2003-01-03", "D", 1), ("H4", "Hall", "house", "TX", "2001-01-03", "2003-01-03", "D", 1)]
    asked = [("senate", "TX", "Ray"), ("senate", "", "Ray"), ("house", "TX", "Hall")]
    rows = spark.createDataFrame([(k, "", *who, None, "2002-01-01", None, "", "x") for k, who in enumerate(asked)], ROWS).drop("tier")
    found = entities.resolve(rows, spark.createDataFrame([], ROSTER), spark.createDataFrame(terms, TERMS))
    assert {r.n: (r.id, r.tier) for r in found.collect()} == {0: ("H1", 4), 1: ("", None), 2: ("", None)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
