"""Clashing column names, odd rows and the whole pipeline against a brute force."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

import corpus_pipeline
from symgraph.llm import jaccard, mixing, quality, substrings, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, source string, lang string, n_chars long, __bad boolean, __host string, row int, rid int, take string, c0 string, `a.b` int, key string"


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(12)
    words = [f"t{i}" for i in range(400)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = make(60), make(150)
    texts = [make(rnd.randint(25, 120)) for _ in range(30)] + [base, base, base + " more", None, "", make(30) + " " + passage + " " + make(30), make(40) + "\n" + passage, "few words", "# $ % " * 30 + make(40), make(6000)]
    rows = [(i, t, rnd.choice(["a", "b", "c", None]), "en", len(t or ""), True, "h", 1, 2, "x", "y", 3, "k") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], "a", None, 0, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASH), rows


@pytest.mark.parametrize("stage", [lambda d: quality.quality_rules(d, keep_columns=True), jaccard.keep_one, substrings.remove_repeats, mixing.mixed_rows])
def test_stages_keep_columns_of_any_name(odd, spark, stage):
    df, rows = odd
    got = stage(df)
    assert got.columns == df.columns and got.schema["text"].dataType == df.schema["text"].dataType
    others = {tuple(r[3:4] + r[5:]) for r in rows}
    assert all(tuple(r)[3:4] + tuple(r)[5:] in others for r in got.collect())
    assert stage(df.limit(0)).count() == 0


def test_quality_rows_follow_the_verdicts(odd):
    df, rows = odd
    kept = sorted(str(r["doc_id"]) for r in quality.quality_rules(df).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in quality.quality_rules(df, keep_columns=True).collect()) == kept
    assert 0 < len(kept) < len(rows)


def test_bad_and_good_hosts(spark):
    rnd = random.Random(1)
    text = lambda: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(40))
    rows = [(i, "short" if i < 30 else text(), "bad") for i in range(36)] + [(100 + i, text(), "good") for i in range(36)]
    rows += [(50, "# $ % & * | < " + text(), "bad"), (150, "# $ % & * | < " + text(), "good")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[50] == (False, False) and got[150] == (False, True) and got[35] == (False, True) and got[0] == (True, False)


def test_verdicts_of_hosts(spark):
    """Plain junk goes on ordinary hosts and stays on the best ones, tables go on the worst ones only; a tiny host is
    like the corpus, whatever its rate."""
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(40))
    junk, table = " ".join(f"w{i} ###" for i in range(40)), " ".join(f"w{i} | x" for i in range(40))
    rows, tests = [], []
    for host, fails in [("best", 1), *[(f"usual{i}", 20) for i in range(60)], ("worst", 55), (None, 20)]:
        rows += [(0, "short" if i < fails else text(), host) for i in range(100)]
        tests += [(host, junk), (host, table), (host, text())]
    tests += [("tiny", x) for x in (junk, table, text())]
    rows += [(1 + i, t, h) for i, (h, t) in enumerate(tests)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df).where("doc_id > 0").collect()}
    kept = {}
    for i, (h, _) in enumerate(tests):
        kept.setdefault(h, []).append(got[1 + i])
    assert kept.pop("best") == [True, True, True] and kept.pop("worst") == [False, False, True]
    assert all(v == [False, True, True] for v in kept.values()), kept
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.sql(f"SELECT doc_id, kept FROM ({quality.OP10_SQL}) WHERE doc_id > 0").fetchall()
    assert dict(want) == got


def test_hot_anchors(spark):
    rnd = random.Random(4)
    words = [f"a{i}" for i in range(900)]
    make = lambda n: [rnd.choice(words) for _ in range(n)]
    sixteen, passage = make(16), make(50)
    texts = [make(30) + sixteen + make(30) for _ in range(25)]  # one anchor of many, never a whole window
    texts += [make(rnd.randint(0, 40)) + passage + make(rnd.randint(0, 40)) for _ in range(25)]
    texts += [["x", "y"] * k for k in (10, 17, 18, 40, 90)] + [["z"] * 80, ["z"] * 35, ["z"] * 34, passage[:35], passage[15:], passage[20:], []]
    places = {}
    for d, w in enumerate(texts):
        for i in range(len(w) - 34):
            places.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + k) for at in places.values() if len(at) > 1 for d, i in at for k in range(35)}
    got = {r["doc_id"]: r for r in substrings.digest_repeats(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")).collect()}
    for d, w in enumerate(texts):
        left = " ".join(x for i, x in enumerate(w) if (d, i) not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), sum((d, i) in gone for i in range(len(w))), hashlib.sha256(left.encode()).hexdigest())


def test_warc_urls_of_one_key(spark, tmp_path):
    big = "x" * 2000
    rows = [(1, "http://a.b/x", "one"), (1, "https://a.b/x#f", "two"), (2, "http://a.b:80/x", big), (2, "http://a.b/x", big), (3, None, None), (4, "http://a.b/x", big + "é" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "k", "d") for r in rows], "page_id long, url string, html string, offset int, key string, digest string")
    got = []
    for k, some in enumerate((pages, pages.limit(0))):
        a, i = str(tmp_path / f"a{k}"), str(tmp_path / f"i{k}")
        shards = warc.write_index(warc.write_archives(some, a), i, shards=2, lines=2)
        found = warc.read_records(warc.look_up(some.select("page_id", "url").distinct(), shards, i), a)
        got.append(sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in found.collect()))
    assert got[0] == [(1, 3, "response"), (1, 3, "response"), (2, 2000, "response"), (2, 2000, "response"), (3, 0, "response"), (4, 602_000, "response")] and got[1] == []


def brute_quality(rows):
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        if len(w) >= 20 and 100 * len({k + j for x in at.values() if len(x) > 1 for k in x for j in range(8)}) <= 30 * len(w):
            out.append(r)
    return out  # on this fixture no host is bad


def brute_near(rows):
    sets = []
    for r in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [rows[min((i for i in range(len(rows)) if label[i] == k), key=order)] for k in sorted(set(label))]


def brute_substrings(rows):
    words = [WORD.findall(r[1] or "") for r in rows]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 34):
            places.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + k) for at in places.values() if len(at) > 1 for d, i in at for k in range(35)}
    return [(r[0], [x for i, x in enumerate(w) if (d, i) not in gone], r[2]) for d, (r, w) in enumerate(zip(rows, words, strict=True))]


def test_pipeline_against_brute_force(odd, spark, tmp_path):
    df, rows = odd
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], (brute_quality, brute_near, brute_substrings), strict=True):
        docs, want = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name.replace(" ", "-")), brute(want)
        got = sorted((str(r["doc_id"]), WORD.findall(r["text"] or ""), str(r["source"])) for r in docs.collect())
        assert got == sorted((str(r[0]), r[1] if isinstance(r[1], list) else WORD.findall(r[1] or ""), str(r[2])) for r in want), name
        want = [(r[0], " ".join(r[1]), r[2]) for r in want] if name == "substring dedup" else want
    # Mixing: each source's words are its target rounded down, of its own texts, whole ones repeated alike.
    mixed = corpus_pipeline.materialize(corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)), "mixed")
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(docs).select("source", "target").distinct().collect()}
    texts = {str(r[0]): WORD.findall(r[1]) for r in want}
    taken, cut, times = {}, {}, {}
    for r in mixed.collect():
        w = WORD.findall(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(w)
        assert w == texts[str(r["doc_id"])][: len(w)]
        if len(w) < len(texts[str(r["doc_id"])]):
            cut[r["source"]] = cut.get(r["source"], 0) + 1
        else:
            times.setdefault(r["source"], {}).setdefault(str(r["doc_id"]), 0)
            times[r["source"]][str(r["doc_id"])] += 1
    assert taken == {k: int(v) for k, v in targets.items() if int(v)} and all(n <= 1 for n in cut.values())
    assert all(max(x.values()) - min(x.values()) <= 1 and max(x.values()) <= 3 for x in times.values())
    # Packing: the tokens of the mixed rows, each once, in gapless sequences.
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in out) == sum(r["length"] for r in corpus_pipeline.packing_stage(spark, mixed, str(tmp_path)).collect())
    ends = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 4096 and len(r["ids"]) == 4 * r["length"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert {str(r["doc_id"]) for r in out} == {str(r["doc_id"]) for r in mixed.select("doc_id").collect()}
