"""License texts and base columns against brute force; pages whose parts have telling names; host consensus."""

import random
import re

from symgraph.llm import html, licenses

TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including",
    "bsd": "Copyright (c) 2001 X. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def test_license_texts():
    s = licenses.Scanner()
    for label, text in TEXTS.items():
        labels = s.scan(f"some words before. {text} and after.")[5].split(",")
        assert label in labels and "proprietary" not in labels, (label, labels)
    assert "isc" not in s.scan(TEXTS["0bsd"])[5].split(",") and "0bsd" not in s.scan(TEXTS["isc"])[5].split(",")
    assert "gpl-3.0" not in s.scan(TEXTS["gpl-2.0"])[5].split(",")


def test_base_columns(spark):
    rnd = random.Random(8)
    parts = ["gnu", "general", "public", "license", "GNU General Public License", "apache", "Apache License", "cc", "by", "CC-BY", "mit", "MIT license.", "é", "Ünder_x", "\n", "a-b"]
    texts = [None, "", "  ", "mit license " * 3000] + [rnd.choice([" ", ", "]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    rows = [(i, t, i, "l") for i, t in enumerate(texts)] + [(None, texts[5], 0, None), (7, texts[7], 7, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, labels string")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(rows) and licenses.scan_licenses(df.limit(0)).count() == 0
    for (i, text, _, _), r in zip(rows, got, strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want = (i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert tuple(r)[:6] == want and {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_parts_with_telling_names():
    inside = "<h2 id='related-work'>Related</h2><h2 id=search>Search</h2><section id='form'><p>of the form</p></section><p class='notice-board'>board</p><p>a <a class='share-price' href=x>share price</a> b</p>"
    assert html.extract_text(f"<article><p>Start of it</p>{inside}</article>") == "Start of it Related Search of the form board a share price b"
    out = "<div class='cookie-notice'>c</div><div class='site-footer'>f</div><section id=comments><p>reader</p></section><div class='social share'><a href=x>tweet this</a></div><ul class='nav-links'><li>n</ul>"
    assert html.extract_text(f"<body>{out}<article><p>Start of it</p>{out}</article></body>") == "Start of it"
    assert html.extract_text("<body><div class='cookie-notice'>We use cookies</div></body>") == ""
    assert html.extract_text("<body><header>x</header><div class=search>find</div></body>") == ""


def test_hosts_without_article(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randint(0, 99)) for _ in range(n))
    page = lambda body, extra="": f"<html><body><nav><a href=x>m</a></nav><div class=page-12>{extra}<div class=story><h1>T</h1><p>{body}</p></div></div></body></html>"
    bodies = [text(80) for _ in range(6)]
    rows = [(i, "https://Host.example/a?b", page(b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://host.example/c", page(bodies[0], "<p>an unmarked notice</p>"))]  # alone it would be taken with its notice
    rows += [(11, "http://other.example/c", page(bodies[0], "<p>an unmarked notice</p>")), (12, None, None), (13, "http://host.example/", ""), (10, "http://host.example/c", page(bodies[0], "<p>an unmarked notice</p>"))]
    df = spark.createDataFrame([(*r, "p", "h") for r in rows], "page_id long, url string, html string, path string, host string")
    got = [(r["page_id"], r["text"]) for r in html.extract_pages(df).collect()]
    want = [(i, f"T {b}") for i, b in enumerate(bodies)] + [(10, f"T {bodies[0]}")] * 2 + [(11, f"an unmarked notice T {bodies[0]}"), (12, ""), (13, "")]
    assert sorted(got) == sorted(want)
    assert html.extract_pages(df.limit(0)).count() == 0


class Plain:
    """An independent extraction for pages with one article: split at tags, drop whole elements by regular expression."""

    DROP = re.compile(r"<!--.*?-->|<(nav|header|footer|aside|form|script|style|head)\b.*?</\1>|<div class=\"ad\">.*?</div>", re.S)

    def __call__(self, page: str) -> str:
        import html as decode

        m = re.search(r"<article>(.*)</article>", self.DROP.sub("", page), re.S)
        text = re.sub(r"</?(?:b|i|em|strong|a|span|u|code)\b[^>]*>", "", m[1])
        return " ".join(" ".join(decode.unescape(x).split()) for x in re.split(r"<[^>]*>", text) if decode.unescape(x).split())


def test_test_pages_against_an_independent_extraction(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    plain, same, n = Plain(), 0, 0
    for r in rows:
        if r["html"] and r["html"].count("<article>") == 1:
            n += 1
            same += got[r["page_id"]] == plain(r["html"])
    assert n > 200 and same >= 0.99 * n, (same, n)
