"""Phrase mining, Merkle manifest and substring dedup against brute force; temporary tables against their scopes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("evseq.llm")
from evseq.llm import common, merkle, phrases, substring_dedup  # noqa: E402

# Names that the operators use themselves, as further columns.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, block int, bucket int, grp string, row int, idx int, proof string, root string, seq string, n int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2, "g", 3, 4, "p", "r", "s", 5) for i, t, lang, s in rows], EXTRA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    prose = lambda n: "".join(rng.choice(vocabulary[: rng.choice([5, 30])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))
    passage, line = prose(50), "One line of SIX plain words. "
    out = [(i, prose(rng.randint(0, 150)), rng.choice(["en", "de", None, "und"]), rng.choice(["a", "b", "é", "", None])) for i in range(60)]
    out += [(100 + k, prose(k) + passage + prose(3 * k), "en", "hot") for k in range(12)]
    out += [(200 + k, out[3][1], "en", "hot") for k in range(9)] + [(300, line * 40, "en", "b"), (301, prose(30) + passage[: len(passage) // 2], "en", "b")]
    out += [(400, None, "en", "a"), (401, "", None, None), (402, " \n\t.", "de", "lone"), (403, "w", "de", "b"), (404, prose(4000), "en", "a"), (405, "x" * 5000, "en", "a"), (7, out[7][1], "en", "a"), (7, out[7][1], "en", "a"), (None, passage, "en", "a")]
    return out


def plain_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_phrases_against_counts(spark, rows, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    f, n = Counter(), Counter()
    for _, t, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain_lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3, 4):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= 30 and len(p) > 2}
    out = defaultdict(list)
    for (lang, *p), a in found.items():
        cuts = [(2_000_000 * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = lambda q: any(q[i : i + len(p)] == tuple(p) for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if not any(len(q) - 1 > len(p) and q[0] == lang and inside(q[1:]) and 100 * b >= 80 * a for q, b in found.items()):
            out[lang].append((-score, -a, " ".join(p).encode(), f[(lang, *p[:k])], f[(lang, *p[k:])]))
    want = {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x), 1)}
    got = phrases.collocations(documents(spark, rows))
    assert len(want) > 20 and {tuple(x) for x in got.collect()} == want
    assert phrases.collocations(documents(spark, rows), 3).count() == sum(min(3, len(x)) for x in out.values())


def test_phrases_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 1 << 44
    d = spark.createDataFrame([(big, big + 1)], "a long, parts long")
    assert d.select(phrases._score(F.col("a"), F.col("parts"))).first()[0] == 2_000_000 * big // (big + 1)
    for a in (np.array([0, 1, 1 << 62, 255]), np.array([7, 0]), np.array([65536]), np.zeros(0, np.int64)):
        assert (phrases.unpacked(phrases.packed(a)) == a).all()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_against_a_list_of_levels(spark, rows, levels):
    """Proofs by walking whole levels, in Python; groups of one leaf, of many buckets, equal rows, null ids and sources."""
    d = documents(spark, rows)
    leaf = lambda *v: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    groups = defaultdict(list)
    for i, t, lang, s in rows:
        n = None if t is None else len(t)
        bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        groups[s].append((i, leaf(i, s, lang, n, t), leaf(i, s, lang, n, t and t.replace("\n", "")) if bad else None))

    def climb(level):
        out = [[] for _ in level]
        at = list(range(len(level)))
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // 3 * 3 : i // 3 * 3 + 3]
                out[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            level, at = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)], [i // 3 for i in at]
        return level[0], out

    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[s] = climb([x[1] for x in groups[s]])
    root, upper = climb([made[s][0] for s in order])
    want = []
    for s, above in zip(order, upper, strict=True):
        for (i, node, bad), below in zip(groups[s], made[s][1], strict=True):
            acc = bad or node
            for a, b in below + above:
                acc = sha(a + acc + b)
            want.append((i, node, made[s][0], root, sha("".join(a + b for a, b in below + above)), acc, acc == root))
    sealed = merkle.manifest(merkle.sealed(d).drop("subroot", "root", "proof"), levels=levels)
    with common.scope():
        assert Counter(map(tuple, merkle.verified(sealed).collect())) == Counter(want)
    assert 0 < sum(x[-1] for x in want) < len(want)


def test_manifest_of_one_row_and_none(spark, rows):
    one = merkle.verified(merkle.sealed(documents(spark, [(1, "a\nb", "en", "s")]))).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] and one[0]["proof_sha256"] == sha("")
    assert merkle.verified(merkle.sealed(documents(spark, []))).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 1500])
def test_substrings_against_all_windows(spark, rows, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _, _ in rows]
    places = defaultdict(list)
    for k, w in enumerate(words):
        for i in range(len(w) - 34):
            places[tuple(w[i : i + 35])].append((k, i))
    gone = [set() for _ in rows]
    for at in places.values():
        for k, i in at if len(at) > 1 else []:
            gone[k].update(range(i, i + 35))
    kept = [" ".join(x for i, x in enumerate(w) if i not in g) for w, g in zip(words, gone, strict=True)]
    want = Counter((r[0], len(w), len(g), sha(k)) for r, w, g, k in zip(rows, words, gone, kept, strict=True))
    got = substring_dedup.repeats(documents(spark, rows)).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == want
    assert all(sum(s["end"] - s["start"] for s in x["repeats"]) == x["n_removed"] for x in got) and sum(x["n_removed"] for x in got) > 1000
    back = substring_dedup.without_repeats(documents(spark, rows))
    assert back.columns == documents(spark, []).columns
    assert Counter((x["doc_id"], x["text"], x["grp"]) for x in back.collect()) == Counter((r[0], k if g else r[1], "g") for r, k, g in zip(rows, kept, gone, strict=True))


def test_windows_of_one_content_have_one_anchor():
    """Whatever stands around a window, the anchor is at the same distance; ties go to the first."""
    rng = np.random.default_rng(4)
    width = substring_dedup.WINDOW - substring_dedup.SEED + 1
    for high in (3, 1 << 40):
        seeds = rng.integers(0, high, 500).astype(np.uint64)
        at = substring_dedup.anchors(seeds, width)
        assert (at == [i + int(np.argmin(seeds[i : i + width])) for i in range(len(seeds) - width + 1)]).all()
    h = rng.integers(0, 50, 300).astype(np.uint64)
    for n in (1, 16, 35):
        runs = substring_dedup.run_hashes(h, n)
        assert len(runs) == 300 - n + 1 and len(set(runs.tolist())) == len({tuple(h[i : i + n]) for i in range(300 - n + 1)})


def test_empty_tables(spark):
    none = documents(spark, [])
    assert phrases.collocations(none).count() == 0 and substring_dedup.repeats(none).count() == 0 and substring_dedup.without_repeats(none).count() == 0


def left_behind(spark):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(context._jsc.sc().getCheckpointDir().get())
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in files.listStatus(path)}


def test_scopes_delete_what_was_made_in_them(spark, rows):
    from evseq.llm import minhash_dedup

    common.prepare(spark)
    before = left_behind(spark)
    with common.scope():
        with common.scope():
            assert common.checkpoint(spark.range(5)).count() == 5
            kept, path = common.written(spark.range(3), outer=True)
        assert kept.count() == 3 and len(left_behind(spark) - before) == 1
        minhash_dedup.near_duplicates(documents(spark, rows), size=2).collect()
        phrases.collocations(documents(spark, rows)).collect()
        merkle.manifest(merkle.sealed(documents(spark, rows))).collect()
        assert left_behind(spark) - before
    assert left_behind(spark) <= before
