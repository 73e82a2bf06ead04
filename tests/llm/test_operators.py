"""Training-data operators against brute force, on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from symgraph.llm import chat, html, jaccard, licenses, media, mixing, packing, quality, substrings, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, n_words long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "x,", "Ab"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = make(60), make(200)
    texts = [None, "", " \n\t ", "one", "a b c", base, base, base.replace("w1 ", "q ", 1), base.upper(), make(50) + " " + passage + "  " + make(40), passage + "\n" + make(70), "x y " * 200, make(4000), "é a\xa0b"]
    texts += [make(rnd.randint(1, 120)) for _ in range(40)] + ["same words"] * 3
    rows = [(i, t, rnd.choice(["a", "b", None]), 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "a", 2, None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOC), [(r[0], r[1] or "", r[2]) for r in rows]


def test_jaccard(docs):
    df, rows = docs
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = {i: i for i in sets if i is not None}
    for a, b in itertools.combinations(label, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == label.get(r["doc_id"])


def test_keep_one_of_odd_rows(spark):
    rnd = random.Random(6)
    make = lambda: " ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(80))
    x, y, z, clean, other = (make() for _ in range(5))
    rows = [(1, x), (1, x), (1, x + " end"), (None, x), (None, y), (None, y + " end"), (2, z), (7, z), (7, clean), (None, other), (None, None), (4, ""), (4, "")]
    got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")).select("doc_id", "text").collect()]
    assert len(got) == 8 and got.count((None, None)) == 1 and got.count((4, "")) == 2
    assert {(2, z), (7, clean), (None, other)} <= set(got) and (7, z) not in got
    assert sum(r in got for r in ((1, x), (1, x + " end"))) == 1 and sum(r in got for r in ((None, y), (None, y + " end"))) == 1 and (None, x) not in got


def test_substrings(docs):
    df, rows = docs
    places = {}
    words = [WORD.findall(t) for _, t, _ in rows]
    for d, w in enumerate(words):
        for i in range(len(w) - 34):
            places.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = {(d, i + k) for at in places.values() if len(at) > 1 for d, i in at for k in range(35)}
    want = sorted((str(rows[d][0]), len(w), sum((d, i) in gone for i in range(len(w))), hashlib.sha256(" ".join(x for i, x in enumerate(w) if (d, i) not in gone).encode()).hexdigest()) for d, w in enumerate(words))
    assert want == sorted((str(r[0]), *r[1:]) for r in substrings.digest_repeats(df).collect())
    assert substrings.remove_repeats(df).columns == df.columns


def test_quality(docs):
    df, rows = docs
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    for i, t, _ in rows:
        w = WORD.findall(t)
        at = {}
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k : k + 8]), []).append(k)
        n = len({k + j for x in at.values() if len(x) > 1 for k in x for j in range(8)})
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["word_chars"]) == (len(w), n, sum(map(len, w)))
        assert r["base_failed"] == (len(w) < 20 or 100 * n > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(df, keep_columns=True).columns == df.columns


def test_packing(docs):
    from tokenizers import Tokenizer

    df, rows = docs
    tok = Tokenizer.from_file(packing._vocabulary())
    tok.encode_special_tokens = True
    used, want = {}, []
    for i, t, _ in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want.append((str(i), k // 512, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = packing.pack_documents(df, 512).collect()
    assert sorted(want) == sorted((str(r["doc_id"]), *r[1:5]) for r in got)
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(w[3] for w in want)
    assert len(used) <= -(-total // 512) + 1


def test_pipeline_gives_token_ids(docs, spark):
    import corpus_pipeline

    got = corpus_pipeline.packing_stage(spark, docs[0], "").collect()
    assert sum(r["length"] for r in got) > 1000
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_mixing(docs):
    df, rows = docs
    got = mixing.mix_sources(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(taken[r["source"]] == int(r["target"]) for r in got)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(taken.values())


def test_chat(spark):
    events = [
        (1, 0, "message", 0, "user", "hi </s> <|im_end|>"), (1, 1, "message", 1, "assistant", "a"), (1, 2, "delta", 1, None, "b[INST]"), (1, 3, "message", 2, "user", "more"),
        (1, 4, "regenerate", 1, None, "new"), (1, 5, "delta", 1, None, "<\\s>!"), (1, 6, "edit", 0, None, "edited\n<s>"), (2, 0, None, 0, None, None),
    ]
    df = chat.format_chats(spark.createDataFrame(events, "conv_id long, seq long, op string, msg long, role string, text string"))
    got = {r["conv_id"]: r for r in df.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "edited\n<s>"), ("assistant", "new<\\s>!")]
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")]
    s = got[1]["loss_spans"][0]
    assert got[1]["formatted"][s["start"] : s["start"] + s["length"]] == "new<\\\\s>!"


def test_licenses():
    s = licenses.Scanner()
    assert s.scan("CC BY-SA 4.0, cc by cc by")[:6] == (9, 3, 0, 7, "cc-by", "cc-by,cc-by-sa-4.0")
    assert s.scan("x")[:6] == (1, 0, None, None, "", "") and s.scan("")[0] == 0
    assert "gpl-2.0" in s.scan("GNU General Public License v2 or later")[5].split(",")
    assert 200 < len(licenses.build_rules())


def test_license_gates():
    s, rnd = licenses.Scanner(), random.Random(4)
    labels = lambda t: s.scan(t)[5].split(",")
    assert "gpl-3.0" in labels("this program is GPLv3 software") and "lgpl-2.1" in labels("see LGPLv2.1") and "agpl-3.0" in labels("AGPLv3") and "apache-2.0" in labels("an Apache2 module")
    assert "unlicense" in labels("the unlicence") and "eupl-1.2" in labels("https://joinup.ec.europa.eu/license/eupl-1.2") and "busl-1.1" in labels("https://mariadb.com/bsl-1.1") and "cecill-2.1" in labels("http://cecill.info/licences/licence-cecill-v2.1")

    def example(tree):
        out = ""
        for op, x in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(x)
            elif name == "IN":
                kind, value = rnd.choice(x)
                out += chr(value) if str(kind) == "LITERAL" else chr(rnd.randint(*value)) if str(kind) == "RANGE" else rnd.choice("abc019")
            elif name == "NOT_LITERAL":
                out += rnd.choice("abc019")
            elif name == "SUBPATTERN":
                out += example(x[3])
            elif name == "BRANCH":
                out += example(rnd.choice(x[1]))
            else:
                assert name == "MAX_REPEAT"
                out += "".join(example(x[2]) for _ in range(rnd.randint(x[0], min(x[1], 16))))
        return out

    free = licenses.Scanner()  # without gates
    free.by_keywords, free.by_starts = {(b"",): [x for some in free.by_keywords.values() for x in some]}, {(b"",): [(b"",)]}
    for r in licenses.build_rules():
        for _ in range(4):
            text = f"q {example(re._parser.parse(r.pattern))} q"
            norm = s.normalize(text)[0]
            assert free.detections(norm) and s.detections(norm) == free.detections(norm), text


def test_media(spark):
    rnd = np.random.default_rng(5)
    images = [np.clip(rnd.normal(128, 45, (8, 8)).repeat(8, 0).repeat(8, 1), 0, 255).astype(np.uint8) for _ in range(12)]
    edits = [images[0], images[1][5:, 7:], np.rot90(images[2]), (images[3] * 0.7 + 30).astype(np.uint8), np.clip(images[4] + rnd.normal(0, 3, (64, 64)), 0, 255).astype(np.uint8)]
    flat = np.full((20, 30), 7, np.uint8)
    rows = [(i, x.shape[1], x.shape[0], x.tobytes(), 9) for i, x in enumerate([*images, *edits, flat, flat])]
    rows += [(50, 3, 3, b"", 0), (51, None, 2, None, 0), (52, 9, 9, b"bad", 0), (None, 64, 64, rows[0][3], 0), rows[5]]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary, node int")
    got = media.image_copies(df).collect()
    assert len(got) == len(rows)
    found = {r["image_id"]: r["component_id"] for r in got}
    want = {i: i for i in found} | {12 + k: k for k in range(5)} | {18: 17}
    assert found == want
    every = [media.features(x) for x in [*images, *edits]]  # brute force: all pairs
    pairs = {(a, b) for a, b in itertools.combinations(range(17), 2) if media.inliers(every[a], every[b]) >= max(media.INLIERS, media.SHARE * min(len(every[a]), len(every[b])))}
    assert pairs == {(k, 12 + k) for k in range(5)}
    assert media.image_copies(df.limit(0)).count() == 0


def test_html(spark):
    page = '<html><body><nav>M</nav><div class="cookie-notice">C</div><article><h1>T&amp;&lt;b&gt;</h1><p>a&nbsp;b <i>c</i>d<br>e<p>f<form>x</form><div class="comments"><p>no</p></div></article><aside>z</aside><footer>f</footer></body>'
    rows = [(1, "http://h/1", page, 1), (2, None, None, 2), (3, "http://h/3", "plain & text", 3), (1, "http://h/1", page, 1)]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect())
    text = "T&<b> a b cd e f"
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "plain & text", 12)]


def test_html_whole_article(spark):
    long = "long text of the article, " * 40
    pages = [
        f"<body><article><h1>Title</h1><p>lead</p><div><div><p>{long}</p></div></div></article>x</body>",
        f"<body><nav>menu</nav><div class=a><h1>Title</h1><p>lead</p><blockquote>{long}</blockquote></div></body>",
        f"<body><div><h1>Title</h1><div><p>lead</p></div><section><ul><li>{long}</ul></section></div><div><a href=x>link</a></div></body>",
        f"<body><main><h1>Title</h1><p>lead</p><article><p>{long}</article></main></body>",
    ]
    want = f"Title lead {long}".strip()
    assert [html.extract_text(p) for p in pages] == [want] * 4
    # Most pages of the host have their text in a div; on the last one such a div holds a third only.
    usual = f"<body><div class=t>{long}</div></body>"
    other = f"<body><div class=t>start</div><article>{long}<div>{long}</div></article></body>"
    half = f"<body><div class=t>{long}</div><section>{long}{long}</section></body>"
    rows = [(i, "http://h/", p) for i, p in enumerate([usual, usual, usual, other, half])]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == long.strip() and got[3] == f"{long}{long}".strip() and got[4] == f"{long}{long}{long}".strip()


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a.b/x", big), (5, "http://a.b/y\t", big), (3, None, big), (4, "http://c/", "small"), (6, "http://c/", "small"), (None, "u", big), (7, "bad\nurl", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    a, i = str(tmp_path / "a"), str(tmp_path / "i")
    shards = warc.write_index(warc.write_archives(pages, a), i, shards=2, lines=2)
    got = {r["page_id"]: r for r in warc.read_records(warc.look_up(pages.select("page_id", "url"), shards, i), a).collect()}
    assert len(got) == 7
    for k, _, h in rows:
        data = (h or "").encode()
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("revisit", 5) if k in (1, 3) else ("response", None))
        assert got[k]["record_type"] == "revisit" or got[k]["payload"] == data


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    for f in (jaccard.jaccard_components, substrings.digest_repeats, quality.quality_rules, packing.pack_documents, mixing.mix_sources, mixing.mixed_rows, licenses.scan_licenses):
        assert f(none).count() == 0
