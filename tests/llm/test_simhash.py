"""Fingerprints with the next text against a plain loop, and the radius search against all pairs."""

import hashlib
import random

from tallybook.llm import simhash
from tallybook.llm.common import WordHashes


def plain(rows):
    known, out = WordHashes(), []
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1]), r[1].encode()))
    for place, (doc_id, text) in enumerate(rows):
        after = rows[(place + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (simhash.fingerprint(t, known) for t in (text, edited, after))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(),
                    simhash.likeness(a, b), simhash.likeness(a, c)))
    return sorted(out, key=str)


def test_next_matches_a_plain_loop(spark):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(60)]
    rows = [(i * 7, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(120)]
    rows += [(7, "twice"), (7, "twice"), (None, None), (-5, ""), (1000, "x" * 200_000)]
    for given, pieces in ((rows, 9), (rows, 1), (rows[:1], 4), (rows[:0], 4)):
        df = spark.createDataFrame([(*r, "clash") for r in given], "doc_id bigint, text string, block string")
        got = sorted((tuple(r) for r in simhash.with_next(df, pieces).collect()), key=str)
        assert got == plain(given)


def test_half_the_text_is_nearer_than_another_text():
    rng, known = random.Random(1), WordHashes()
    words = [f"w{i}" for i in range(5000)]
    a, b = (" ".join(rng.choices(words, k=400)) for _ in range(2))
    mixed = a[: len(a) // 2] + b[: len(a) // 2]
    one, two, three = (simhash.fingerprint(t, known) for t in (a, mixed, b))
    assert simhash.likeness(one, two) > simhash.likeness(one, three) + 0.08
    assert simhash.likeness(one, one) == 1 and simhash.fingerprint(None, known) == bytes(32)


def test_radius_search_finds_all(spark):
    rng, bits, radius = random.Random(5), 64, 3
    base = [rng.getrandbits(bits) for _ in range(30)]
    values = base + [b ^ sum(1 << p for p in rng.sample(range(bits), rng.randint(0, 5))) for b in base for _ in range(4)]
    hexes = [f"{v:016x}" for v in values]
    prints = spark.createDataFrame([(h,) for h in [*hexes, hexes[0]]], "fingerprint string")
    got = {(r.query, r.found, r.distance) for r in simhash.within_radius(prints, prints.limit(40), radius, bits=bits).collect()}
    asked = {r.fingerprint for r in prints.limit(40).collect()}
    want = {(a, b, d) for a in asked for b in set(hexes) if a != b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    assert got == want and want
    wider = simhash.within_radius(prints, prints, radius, blocks=5, chosen=2, bits=bits).count()
    assert wider == sum(1 for a in set(hexes) for b in set(hexes) if a != b and (int(a, 16) ^ int(b, 16)).bit_count() <= radius)
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id bigint, text string")
    assert simhash.fingerprints(docs).where("fingerprint = repeat('0', 64)").count() == 2
