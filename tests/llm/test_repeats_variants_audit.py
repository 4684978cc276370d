"""Repeated byte strings, spelling variants and the filter audit against brute force, on hard rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_operators import DOCS, docs, none, odd, rows  # noqa: F401  fixtures

import __spark_entry__ as entry
from lodestrata.llm import filter_audit, spelling, suffix_array

SF = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


@pytest.mark.parametrize("name", ["op11_suffix_array", "op12_spelling", "op13_filter_audit"])
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def brute_bytes(rows):
    """What op11 gives, for rows with distinct ids."""
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc] = len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()
    return out


def found_bytes(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.deduplicated(df).drop("removed").collect()}


@pytest.mark.parametrize("group", [1 << 16, 50])
def test_repeated_bytes(docs, rows, none, group, monkeypatch):  # noqa: F811
    monkeypatch.setattr(suffix_array, "GROUP", group)
    assert found_bytes(docs) == brute_bytes(rows)
    assert suffix_array.deduplicated(none).count() == 0


def test_repeated_bytes_of_odd_rows(odd):  # noqa: F811
    out = suffix_array.deduplicated(odd).collect()
    # repeated rows of id 1 are judged alike, and null ids not at all; none repeats 100 bytes but "x y z", whose rows have no id
    assert len(out) == 6 and all(r.n_removed == 0 for r in out) and sorted(r.n_bytes for r in out) == [0, 21, 85, 85, 120, 120]


@pytest.mark.parametrize("partitions", [1, 4])
def test_repeated_bytes_of_a_common_passage(spark, partitions):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz é"
    text = lambda k: "".join(rng.choices(letters, k=k))
    passage = text(420)
    rows = [(i, text(rng.randint(0, 90)) + passage[: rng.choice([420, 250, 130])] + text(rng.randint(0, 90)), None, None, None) for i in range(500)]
    rows += [(900 + i, passage * 3 + "-" + passage, None, None, None) for i in range(3)] + [(950, "ab" * 900, None, None, None), (951, text(30) + "ab" * 300, None, None, None)]
    rng.shuffle(rows)
    assert found_bytes(spark.createDataFrame(rows, DOCS).repartition(partitions)) == brute_bytes(rows)


def test_rows_of_one_id_are_judged_apart(spark):
    a, b = "".join(map(str, range(100))), "".join(map(str, range(300, 400)))
    out = suffix_array.deduplicated(spark.createDataFrame([(1, a + b, None, None, None), (1, a, None, None, None), (2, b, None, None, None), (2, b, None, None, None)], DOCS)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in out) == [(1, 190, 0), (1, 490, 0), (2, 300, 300), (2, 300, 300)]


def test_suffixes_are_in_order():
    rng = random.Random(7)
    strings = ["".join(rng.choices("ab\0", k=rng.randint(0, 40))).encode() for _ in range(600)]
    strings += [b"c" * 30 + s for s in strings[:200]] + strings[:50]
    place, common = suffix_array.ordered(strings)
    want = sorted(set(strings))
    assert [want[p] for p in place] == strings
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0, *(lcp(a, b) for a, b in zip(want, want[1:], strict=False))]
    words = np.array([[rng.randrange(3), rng.randrange(9)] for _ in range(400)], np.uint64)
    order, first = suffix_array.multikey(words)
    assert words[order].tolist() == sorted(words.tolist()) and first.sum() == len({*map(tuple, words.tolist())})


def test_anchors_do_not_depend_on_steps(monkeypatch):
    data = random.Random(3).randbytes(5000)
    whole = dict(zip(suffix_array.anchors(data)[1].tolist(), suffix_array.anchors(data)[0].tolist(), strict=True))
    monkeypatch.setattr(suffix_array, "STEP", 333)
    key, place, first, n = suffix_array.anchors(data)
    assert dict(zip(place.tolist(), key.tolist(), strict=True)) == whole and n.sum() == len(data) - 99 and (first <= place).all()


def brute_variants(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in LETTERS.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, cut), same in gaps.items():
        for w in same:
            near[w] |= same - {w}
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


def found_variants(df):
    out = spelling.variants(df).collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}
    assert len(found) == len(out)
    return found


@pytest.mark.parametrize("bucket", [spelling.BUCKET, 12])
def test_variants(spark, docs, rows, none, odd, bucket, monkeypatch):  # noqa: F811
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(6)
    stems, texts = ["".join(rng.choices("abé", k=rng.randint(5, 12))) for _ in range(60)], []
    for stem in stems * 12:
        i, kind = rng.randrange(len(stem) + 1), rng.randrange(4)
        texts.append(" ".join([stem[:i] + ["", "a", "b", ""][kind] + stem[i + (kind > 1) :]] * rng.choice([1, 3, 4, 9, 30])))
    mine = [(i, t.upper() if i % 5 == 0 else t, None, None, None) for i, t in enumerate(texts)]
    assert found_variants(spark.createDataFrame(mine, DOCS)) == brute_variants(mine)
    assert found_variants(docs) == brute_variants(rows)
    assert found_variants(odd) == brute_variants([tuple(r) for r in odd.select(*[c.split()[0] for c in DOCS.split(", ")]).collect()])
    assert spelling.variants(none).count() == 0


def test_each_pair_of_near_words_has_one_way():
    rng = random.Random(9)
    words = {"".join(rng.choices("ab", k=rng.randint(5, 9))) for _ in range(120)}

    def of(word, owned, steps):
        keys = [("", "", "")]
        for _ in range(steps):
            keys = [k for key in keys for k in spelling.halves(*key, word, owned)]
        return keys

    for steps in (1, 2):
        for w in words:
            for x in words:
                if spelling.one_edit(w, x):
                    shared = [k for k in of(w, True, steps) if k in of(x, False, steps) and spelling.way_of(w, x, steps) == k[2]]
                    assert len(shared) == 1, (w, x, shared)


def brute_audit(rows, labels):
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in range(2))
    texts = [(d, lang or "", t or "") for d, t, lang, *_ in rows]
    least = {}
    for d, _, t in texts:
        if d is not None:
            least[t] = min(d, least.get(t, d))

    def fails(d, t):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        tests = {"A": len(w) < 100, "B": 100 * len({*w}) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        return {k for k, v in tests.items() if v}

    known, out = [(d, p, fails(d, t)) for d, p, t in texts], {}
    for part in {p for _, p, _ in known}:
        own, shapley = [(d, f) for d, p, f in known if p == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left, earlier = own, []
            for k, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, order, k] = [len(left), len(gone), sum(letter in f for _, f in earlier), sum(f == {letter} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[letter] += len(gone)
                earlier += gone
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark, docs, rows, odd, none, monkeypatch):  # noqa: F811
    labels = [(d, i % 2, i % 3 % 2) for i, (d, *_) in enumerate(rows)] + [(3, 0, 0), (10, None, None), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = [c.split()[0] for c in DOCS.split(", ")]
    for df, these in ((docs, rows), (odd, [tuple(r) for r in odd.select(*names).collect()])):
        out = filter_audit.audit(df, known).collect()
        got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
        assert len(out) == len(got) and got == brute_audit(these, labels)
    assert filter_audit.audit(none, known).count() == 0
