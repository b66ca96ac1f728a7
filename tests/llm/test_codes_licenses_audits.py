"""Vector codes, licence scans and filter audits against brute force, and edge rows."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import filter_audit, licenses, registry, vector_codes
from tests.llm.test_operators import documents

# --- vector codes -------------------------------------------------------------------------------


def brute_codes(rows):
    """(codes by row, errors, label errors, codebooks) of rows (id, vector, label) by plain loops."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max([1, *(len(v) for _, v, _ in kept)]) // 4) * 4
    whole = [(i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in v] + [0] * (dims - len(v)), label) for i, v, label in kept]
    first = {}
    for i, v, _ in sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    w = dims // 4
    books = [[v[p * w : (p + 1) * w] for v in list(first.values())[:256]] for p in range(4)]

    def assign(v):
        out = []
        for p in range(4):
            part = v[p * w : (p + 1) * w]
            out.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p])))
        return out

    for _ in range(4):
        found = [assign(v) for _, v, _ in whole]
        for p in range(4):
            for k in range(len(books[p])):
                own = [v[p * w : (p + 1) * w] for (_, v, _), f in zip(whole, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [assign(v) for _, v, _ in whole]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(whole, errors, strict=True):
        total[label] = total.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[label]) for (i, _, label), f, e in zip(whole, found, errors, strict=True)), key=str), books


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return frame.withColumns({c: F.lit("clash") for c in ("id", "v", "code", "_label", "dims", "part")})


def codes(spark, rows):
    coded, books = vector_codes.compress(vectors(spark, rows))
    return sorted(map(tuple, vector_codes.label_errors(coded).select("id", "code", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize("n, dims", [(300, 8), (40, 4), (270, 12)])
def test_codes_equal_brute_force(spark, n, dims):
    draw = random.Random(n)
    centres = [[draw.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, 0.05) for c in draw.choice(centres)], draw.choice([0, 0, 1, None])) for i in draw.sample(range(5 * n), n)]
    rows += [rows[3], rows[3]]
    got, books = codes(spark, rows)
    want, plain = brute_codes(rows)
    assert got == want and [b.tolist() for b in books] == plain


def test_codes_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [nan, 0.0], 1), (4, [inf], None), (5, [1.0, None], None), (6, [0.5, -0.0005, 0.25], None), (7, [1e300, -1e300, 3.0, 1.0, 2.0], 2), (7, [0.0] * 5, 2), (None, [0.1], 3), (None, [0.2], 3), (9, [0.1], None)]
    got, books = codes(spark, rows)
    want, plain = brute_codes(rows)
    assert got == want and [b.tolist() for b in books] == plain
    assert codes(spark, []) == ([], []) and codes(spark, [(1, None, 1)]) == ([], [])


def test_nearest_is_exact_with_ties():
    draw = np.random.default_rng(4)
    for dims, spread, n in [(1, 3, 70), (16, 40, 256), (2, 2, 256), (3, 1 << 26, 64), (5, 10, 1)]:
        entries, x = draw.integers(-spread, spread + 1, (n, dims)), draw.integers(-2 * spread, 2 * spread + 1, (500, dims))
        found, apart = vector_codes.Slices.of(entries).nearest(x)
        every = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (found == every.argmin(1)).all() and (apart == every.min(1)).all()


def test_masks_hold_the_box():
    draw = np.random.default_rng(5)
    entries, x = draw.integers(-9, 10, (130, 3)), draw.integers(-9, 10, (50, 3))
    inside = vector_codes.Slices.of(entries).candidates(x, np.full(50, 4))
    assert (inside == (np.abs(x[:, None] - entries[None]) <= 4).all(2)).all()


def test_label_sums_are_joined_where_labels_are_many(spark, monkeypatch):
    rows = [(i, [0.01 * i, 0.5], i % 3 or None) for i in range(60)]
    want, _ = brute_codes(rows)
    monkeypatch.setattr(vector_codes, "SMALL_LABELS", 1)
    assert codes(spark, rows)[0] == want


# --- licences -----------------------------------------------------------------------------------


def brute_licences(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    """(n_words, places, matches by template (end, template end, words)) by comparing slices."""
    words = licenses.words_of(text)
    places = sorted((i, i + len(p), label) for phrase, label in phrases.items() for p in [licenses.words_of(phrase)] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    known = [licenses.words_of(t) for _, t in templates] + [licenses.words_of(p) for p in phrases]
    runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
    held = [max((n for n in range(1, min(i, 140) + 1) if tuple(words[i - n : i]) in runs), default=0) for i in range(1, len(words) + 1)]
    matches = {}
    for i, n in enumerate(held, 1):
        if n >= licenses.LONG and (i == len(words) or held[i] <= n):
            for k, t in enumerate(known[: len(templates)]):
                for end in range(1, len(t) + 1):
                    m = 0
                    while m < min(n, end) and words[i - m - 1] == t[end - m - 1]:
                        m += 1
                    if m >= licenses.LONG:
                        matches.setdefault(k, []).append((i, end, m))
    return len(words), places, matches


def licence_texts():
    draw = random.Random(8)
    noise = [*"the of in and software copy license any to this with mit apache general public É".split(), "lorem"]
    out = ["", None, "MIT License", "the mit-license, mit license. MIT  LICENSE!", "general public license " * 3, "apachelicense apache", "É mit é license"]
    for _, t in licenses.TEMPLATES:
        w = t.split()
        out += [t, t.upper(), " ".join(w[: len(w) // 2]), " ".join(x for k, x in enumerate(w) if k % 9)]
        out.append(" ".join(draw.choices(noise, k=30) + w[len(w) // 5 :] + draw.choices(noise, k=20) + w))
    out += [" ".join(draw.choices(noise, k=60)) for _ in range(20)]
    return out


def test_licences_equal_brute_force():
    known = licenses.Licences()
    for text in licence_texts():
        n, places, matches = brute_licences(text)
        got = known.scan((text or "").encode())
        assert (got[0], sorted(got[1])) == (n, places), text
        want = sorted((s, e, known.labels[k], c / known.sizes[k]) for k, found in matches.items() for s, e, c in licenses.chained(found))
        assert sorted(got[2]) == want, text


def test_templates_are_found_whole():
    known = licenses.Licences()
    for label, t in licenses.TEMPLATES:
        assert (label, 1.0) in {(x[2], x[3]) for x in known.scan(f"Some words before. {t} And after.".encode())[2]}
    mit = licenses.TEMPLATES[0][1].split()
    changed = " ".join(f"{w} lorem" if k % 12 == 5 else w for k, w in enumerate(mit))
    best = max(known.scan(changed.encode())[2], key=lambda x: x[3])
    assert best[2] == "mit" and best[3] >= 0.6


def test_chains_follow_text_and_template():
    assert licenses.chained([(10, 10, 10), (25, 22, 10)]) == [(0, 25, 20)]
    assert sorted(licenses.chained([(10, 22, 10), (25, 10, 10)])) == [(0, 10, 10), (15, 25, 10)]  # the other way round
    assert licenses.chained([(10, 10, 10), (18, 18, 12)]) == [(0, 18, 18)]  # four words twice
    assert len(licenses.chained([(10, 10, 10), (80, 22, 10)])) == 2  # too far apart


def test_statistics_of_several_sequences():
    draw = random.Random(2)
    for _ in range(60):
        sequences = [[b"%d" % draw.randrange(3) for _ in range(draw.randrange(1, 9))] for _ in range(draw.randrange(1, 5))]
        text = [b"%d" % draw.randrange(4) for _ in range(30)]
        machine = licenses.Automaton(sequences)
        for i, (state, held) in enumerate(machine.statistics(text), 1):
            inside = lambda n: [(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == text[i - n : i]]  # noqa: B023, E731
            assert held == max((n for n in range(1, i + 1) if inside(n)), default=0)
            assert not held or list(machine.ends[state]) == inside(held)


def test_licence_query_on_edges(spark):
    long = "word " * 50_000 + licenses.TEMPLATES[5][1] + " word" * 50_000
    rows = [(1, None), (2, ""), (3, "MIT License apache license mit license"), (3, "MIT License apache license mit license"), (None, "no license"), (5, long), (6, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.n_words, len(r.places), round(r.best, 3), tuple(sorted({s.label for s in r.spans}))) for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert got == {(1, 0, 0, 0.0, ()), (2, 0, 0, 0.0, ()), (3, 6, 3, 0.0, ()), (None, 2, 0, 0.0, ()), (5, 100_008, 1, 1.0, ("apache",)), (6, 7, 0, 1.0, ("cc-by-nc",))}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_licence_query_against_brute_force(spark, small):
    for r in registry.queries()["op12_licenses"](spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        n, places, matches = brute_licences(r.text if "icense" in (r.text or "") else " ".join((r.text or "").split()[:400])) if "icense" in (r.text or "") else (r.n_words, [], {})
        starts = [p[0] for p in places]
        shares = [(licenses.TEMPLATES[k][0], c / len(licenses.words_of(licenses.TEMPLATES[k][1]))) for k, found in matches.items() for _, _, c in licenses.chained(found)]
        base = sorted({p[2] for p in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
        assert r.labels == ",".join(sorted({*base, *(label for label, s in shares if s >= licenses.SHARE)}))
        assert abs(r.score - max([0.5 if places else 0.0, *(s for _, s in shares)])) < 1e-9 or "icense" not in (r.text or "")


# --- filter audit -------------------------------------------------------------------------------


def brute_audit(rows, labels):
    import re

    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    parts = {}
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": smaller}
        parts.setdefault(part or "", []).append((i, {k for k, v in fails.items() if v}))
    out = []
    for part, docs in parts.items():
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[1]]
                left = [d for d in left if k not in d[1]]
                shapley[k] += len(gone)
                failing = sum(k in f for _, f in docs)
                found.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {k} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), k))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    draw = random.Random(6)
    texts = [None, "", "Short", "a # b", " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "same " * 300, "same | " * 300, " ".join(f"w{i}" for i in range(199)), "É " * 201, "x y \U0001f600" * 210]
    rows = [(draw.choice([None, *range(30)]), draw.choice(texts), draw.choice(["s", "s", "t", "", None])) for _ in range(120)]
    rows += [(31, "long " * 40_000, "u"), (32, "long " * 40_000, "u"), (32, "long " * 40_000, "u")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [*range(33), 3, 3, None]]
    docs = documents(spark, [r[:2] for r in rows]).limit(0)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in docs.columns if c not in ("doc_id", "text", "source")}).withColumns({c: F.lit(1) for c in ("mask", "part", "print", "good", "words")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(0))
    got = filter_audit.audit(filter_audit.failure_cells(frame, said)).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.failure_cells(frame.limit(0), said)).count() == 0


def test_gray_walk_gives_the_survivors_of_every_subset():
    cells = np.random.default_rng(1).integers(0, 50, (32, 3))
    states = filter_audit.gray_states(cells)
    for active in range(32):
        assert (states[active] == cells[(np.arange(32) & active) == 0].sum(0)).all()
