"""Periodic runs and licence scans against brute force."""

import hashlib
import random
import re
import zlib
from math import log

import numpy as np
import pytest

from tracequarry.llm import licenses, periodic
from tracequarry.llm.queries import QUERIES


def every_run(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = []
    for _ in range(rng.randint(0, 5)):
        letters = rng.choice([1, 2, 3, 50])
        if rng.random() < 0.5:
            w += [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        else:
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 40))] * rng.choice([1, 1, 2]) + [99] * rng.randint(0, 1)
            w += (unit * 8)[: rng.randint(1, 6 * len(unit))]
    return w


def test_runs_of_random_texts():
    rng, some = random.Random(1), 0
    for _ in range(300):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        got = periodic.runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64))
        want = [every_run(d) for d in docs]
        assert got == want
        some += sum(map(len, want))
    assert some > 500


def test_runs_of_hard_texts():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    fibonacci = [*map(ord, b[:3000])]
    assert periodic.runs(np.array(fibonacci), np.array([3000]))[0] == every_run(fibonacci)
    long = np.tile(np.random.default_rng(1).integers(0, 50000, 70001), 4)[:230_000]
    assert periodic.runs(long, np.array([len(long)])) == [[(0, 230_000, 70001)]]
    assert periodic.runs(np.zeros(100_000, np.int64), np.array([100_000])) == [[(0, 100_000, 1)]]


def as_contract_says(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_run(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, " \t".join(f"é{x}" for x in repetitive(rng))) for i in range(120)]
    rows += [(500 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 200)))) for i in range(120)]
    rows += [(None, "a " * 60), (7, None), (8, ""), (9, " \n\x0b "), (10, "x\x1cy z " * 30), (11, "b" * 100_000)]
    rows = [(i, t, "key", 1) for i, t in rows]
    top = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(rows + rows[:40], "doc_id long, text string, periodic string, start int").write.parquet(f"{top}/documents.parquet")
    return str(top), rows + rows[:40]


def test_runs_query(spark, texts):
    top, rows = texts
    got = QUERIES["op11_periodic_runs"](spark, top).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *as_contract_says(i, t)) for i, t, *_ in rows), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 50


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(w, phrase):
    return [i for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase)] == phrase]


def labelled(text, docs):
    """The module's rule by trying every place: rare words near, mandatory phrases near."""
    bags, w, best = [set(tokens(t)) for t in docs], tokens(text), {}
    idf = lambda x: log(1 + (len(docs) + 1) / (sum(x in b for b in bags) + 1))
    for label, notice, needed in licenses.TEMPLATES:
        t = tokens(notice)
        rare = sorted(set(t), key=lambda x: (-idf(x), x))[: licenses.RARE]
        slack, total = 2 + len(t) // 16, sum(map(idf, rare))
        offsets = {x: sorted({i - j for i, y in enumerate(w) if y == x for j, z in enumerate(t) if z == x}) for x in rare}
        for low in sorted({o for some in offsets.values() for o in some}):
            near = {x: [o for o in offsets[x] if low <= o <= low + slack] for x in rare}
            share = sum(idf(x) for x in rare if near[x]) / total
            high = max(o for some in near.values() for o in some)
            fits = all(any(low - slack <= p - places(t, tokens(f))[0] <= high + slack for p in places(w, tokens(f))) for f in needed)
            if share >= licenses.SHARE - 1e-9 and fits:
                best[label] = max(best.get(label, 0), share)
    return best


@pytest.fixture(scope="module")
def notices(spark, tmp_path_factory):
    rng = random.Random(9)
    common = "the of license a software work under free public copyright in and to is by version use".split()
    filler = lambda n: [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(90)}" for _ in range(n)]
    docs = [None, "", "--- ...", "CC BY CC-BY cc, by", "All rights\nreserved. ALL RIGHTS RESERVED all rights", "general public license general public license", "ccé by"]
    for k in range(90):
        w = filler(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            notice = tokens(rng.choice(licenses.TEMPLATES)[1])
            for _ in range(rng.choice([0, 0, 1, 4, 15])):
                notice[rng.randrange(len(notice))] = rng.choice(common)
            if rng.random() < 0.3:
                del notice[rng.randrange(len(notice))]
            w += [x.title() for x in notice] + filler(rng.randint(0, 40))
        docs.append(rng.choice([" ", ", ", "\n"]).join(w))
    docs += docs[20:25]
    top = tmp_path_factory.mktemp("notices")
    spark.createDataFrame([(i if i != 9 else None, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, licenses string, n_words int").write.parquet(f"{top}/documents.parquet")
    return str(top), docs


def test_licenses_query(spark, notices):
    top, docs = notices
    got = {r["doc_id"]: r for r in QUERIES["op13_license_labels"](spark, top).collect()}
    assert len(got) == len(docs)
    seen = set()
    for i, text in enumerate(docs):
        r, w = got[i if i != 9 else None], tokens(text)
        at = sorted((p, label) for phrase, label in licenses.PHRASES for p in places(w, tokens(phrase)))
        best = labelled(text, docs)
        base = {label for _, label in at}
        seen |= set(best)
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted(base)))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["labels"] == ",".join(sorted(base | set(best)))
        assert r["score"] == pytest.approx(1.0 if at else max(best.values(), default=0.0))
    assert len(seen) > 8


def test_licenses_are_read_whole(spark):
    text = "filler " * 200_000 + licenses.TEMPLATES[3][1] + " all rights reserved"
    row = licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).first()["licenses"]
    assert row["n_words"] == 200_000 + len(tokens(licenses.TEMPLATES[3][1])) + 3 and [x["label"] for x in row["notices"]] == ["mit"]
    assert [tuple(x) for x in row["places"]] == [(row["n_words"] - 3, "reserved")]


@pytest.mark.parametrize("mark", ["point", "dot", "at ", "(at)", "@", "arroba", "plus", "five", "_at_", "(dot)"])
def test_personal_data_beside_long_blanks(mark):
    import time

    from tracequarry.llm import pii

    for text in ("a" + " " * 1_000_000 + mark + " of view", ("word" + " " * 2000) * 300 + mark + " x", (mark + " " * 2000) * 300):
        began = time.perf_counter()
        pii.detect(text)
        assert time.perf_counter() - began < 5  # a second, with others on the machine
    disguised = "write bob" + " " * 5000 + "(at)" + "\t" * 5000 + "x.example" + " " * 5000 + "dot" + " " * 5000 + "com"
    assert [disguised[s:e] for s, e, k in pii.detect(disguised)[1] if k == 0] == [disguised[6:]]


def test_damaged_media_load_or_raise():
    import time

    from tracequarry.llm import media

    rng = random.Random(1)
    for file in media.store([bytes(rng.randrange(256) for _ in range(192 * k)) for k in (1, 3)]):
        for k in range(1500):
            i = k if k < 1000 else rng.randrange(len(file))
            changed = bytearray(file)
            changed[i] = (changed[i] + rng.randrange(1, 256)) & 255
            began = time.perf_counter()
            try:
                [*media.load([bytes(changed)])]
            except ValueError:
                pass
            assert time.perf_counter() - began < 1
    nested = b"LIST\xff\xff\xff\x00hdrl" * 3000
    with pytest.raises(ValueError):
        media.parse(b"RIFF" + len(nested).to_bytes(4, "little") + b"AVI " + nested)
