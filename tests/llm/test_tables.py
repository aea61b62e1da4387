"""Archives, rollups and licences."""

import json
import math
import random
import re

import pytest

from sparkrag.llm import licenses, rollup, warc

PAGES = "page_id long, url string, html string, digest string, refers_to long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], PAGES)


BIG = "<p>" + "é" * 600 + "</p>"
ROWS = [(1, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (3, None, "<p>small</p>"), (4, "u", "<p>small</p>"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (10, "u", "y" * 1000), (10, "u", "y" * 1000), (None, "u", "z" * 2000), (12, "u", "z" * 2000), (13, "u", "\r\n\r\nWARC/1.1\r\n" + "q" * 3000)]


def test_archives_round_trip(spark, tmp_path):
    files = warc.write(pages(spark, ROWS).repartition(3), f"file://{tmp_path}/w")
    got = warc.read(spark, files)
    import gzip

    raw = [open(f.removeprefix("file://"), "rb").read() for f in files]  # other readers find gzip members, of which each is a record
    assert all(r[:2] == b"\x1f\x8b" and gzip.decompress(r)[:9] == b"WARC/1.1\r" for r in raw)
    rows = [(r.headers["warc-page-id"], r.record_type, r.headers.get("warc-refers-to-page-id"), r.payload) for r in got.collect()]
    last = {}
    for i, _, h in ROWS:
        if h and len(h.encode()) >= 1000 and i is not None:
            last[h] = max(last.get(h, i), i)
    want = [(str(i) if i is not None else "", "response", None, (h or "").encode()) if last.get(h) in (None, i) else (str(i) if i is not None else "", "revisit", str(last[h]), b"") for i, _, h in ROWS]
    assert sorted(rows, key=str) == sorted(((a, b, c, bytearray(p)) for a, b, c, p in want), key=str)


def test_predicates_skip_payloads(spark, tmp_path):
    files = warc.write(pages(spark, ROWS).coalesce(1), f"file://{tmp_path}/w")
    every = [(r.record_type, r.record_id, r.date, r.headers["warc-page-id"]) for r in warc.read(spark, files).collect()]
    assert sum(r[0] == "revisit" for r in every) == 3 and len(every) == len(ROWS)
    for where, keep in [
        ("record_type = 'revisit'", lambda r: r[0] == "revisit"),
        ("record_type <=> 'response'", lambda r: r[0] == "response"),
        ("record_type IN ('revisit', 'x') AND date >= '2024'", lambda r: r[0] == "revisit"),
        ("date < '2024'", lambda r: False),
        ("headers.`warc-page-id` LIKE '1%'", lambda r: r[3].startswith("1")),
        ("content_type IS NULL", lambda r: False),
        ("date IS NOT NULL AND content_length > 0", lambda r: True),
    ]:
        assert sorted((r.record_type, r.record_id, r.date, r.headers["warc-page-id"]) for r in warc.read(spark, files).where(where).collect()) == sorted(filter(keep, every)), where
    plan = warc.read(spark, files).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source decides it alone
    assert warc.read(spark, files, payload=False).where("payload IS NOT NULL").count() == 0
    seen = []
    for headers, block in warc.records(files[0], lambda h: (seen.append(h), h["warc-type"] == "revisit" and None)[1]):
        assert headers["warc-type"] == "response" and block is None
    assert len(seen) == len(ROWS)


def test_plain_and_unsized_members(tmp_path):
    import gzip

    raw = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], b"x" * i) for i in (0, 5, 70_000)]
    (tmp_path / "a.warc").write_bytes(b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    for name in ("a.warc", "b.warc.gz"):
        assert [len(b) for _, b in warc.records(str(tmp_path / name), lambda h: True)] == [0, 5, 70_000]
    folded = warc.parse_headers(b"WARC/1.0\r\nA: b\r\n c\r\nD: e")
    assert folded == {"a": "b c", "d": "e"}
    with pytest.raises(ValueError):
        warc.parse_headers(b"HTTP/1.1 200")


def test_archives_are_split_between_records(spark, tmp_path):
    files = warc.write(pages(spark, ROWS).repartition(2), f"file://{tmp_path}/w", split=300)
    parts = warc.WarcReader({"files": json.dumps(files)}).partitions()
    assert len(files) == 2 and len(parts) > 6
    whole = sorted((h["warc-record-id"], b) for f in files for h, b in warc.records(f, lambda h: True))
    assert sorted((h["warc-record-id"], b) for p in parts for h, b in warc.records(p.value[0], lambda h: True, *p.value[1:])) == whole
    assert warc.read(spark, files).count() == len(ROWS)


def test_repeated_digests_in_a_shuffle(spark):
    few, many = (sorted((r.page_id or 0, r.refers_to or 0, r.digest) for r in warc.plan_records(pages(spark, ROWS), most=m).collect()) for m in (1000, 0))
    assert few == many


def test_no_pages(spark, tmp_path):
    files = warc.write(pages(spark, []), f"file://{tmp_path}/w")
    assert files == [] and warc.read(spark, files).count() == 0


# ---------------------------------------------------------------- rollups

CHANGE = "op string, source string, lang string, tokenizer string, tokens long, n_chars long, docs long"


def test_rollup_agrees_with_a_dict(spark, tmp_path):
    rng = random.Random(1)
    r, want = rollup.Rollup(spark, f"file://{tmp_path}/r"), {}
    sent = []
    for b in range(4):
        rows = [(rng.choice(["insert", "insert", "delete"]), rng.choice(["a", "b", None]), rng.choice(["en", None]), "t/1", rng.choice([None, 1, 5]), rng.randint(0, 9), 1) for _ in range(30)]
        sent.append(rows)
        assert r.apply(f"b{b}", spark.createDataFrame(rows, CHANGE))
        for op, s, lang, t, n, c, _ in rows:
            k = want.setdefault((s, lang, t), [0, 0, 0])
            sign = 1 if op == "insert" else -1
            k[0] += sign
            k[1] += sign * (n or 0)
            k[2] += sign * c
    assert not r.apply("b1", spark.createDataFrame(sent[1], CHANGE))
    with pytest.raises(ValueError):
        r.apply("b1", spark.createDataFrame(sent[2], CHANGE))
    for _ in range(2):
        got = {(x.source, x.lang, x.tokenizer): [x.docs, x.tokens, x.chars] for x in r.totals().collect()}
        assert got == {k: v for k, v in want.items() if any(v)}
        r.compact()
    assert not r.apply("b3", spark.createDataFrame(sent[3], CHANGE))
    assert r.apply("empty", spark.createDataFrame([], CHANGE))


def test_rollup_rejects_unknown_changes(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    with pytest.raises(Exception, match="no such op"):
        r.apply("x", spark.createDataFrame([("upsert", "a", "en", "t", 1, 1, 1)], CHANGE))
    assert r.totals().count() == 0


def test_compaction_is_one_step(spark, tmp_path, monkeypatch):
    rows = [[("insert", "a", "en", "t", b + 1, 10, 1)] * (b + 1) for b in range(3)]
    folder = f"file://{tmp_path}/r"
    r = rollup.Rollup(spark, folder)
    for b, own in enumerate(rows):
        assert r.apply(f"part/{b}", spark.createDataFrame(own, CHANGE))
    want = [("a", "en", "t", 6, 14, 60)]
    seen = lambda: [tuple(x) for x in rollup.Rollup(spark, folder).totals().collect()]
    put = rollup.put_new

    class Lost(Exception):
        pass

    for when in ("before", "after"):  # the driver is lost on either side of the only write that counts

        def lose(s, uri, data, when=when):
            if when == "after":
                assert put(s, uri, data)
            raise Lost

        monkeypatch.setattr(rollup, "put_new", lose)
        with pytest.raises(Lost):
            r.compact()
        monkeypatch.setattr(rollup, "put_new", put)
        assert seen() == want
        if when == "before":

            def late(s, uri, data):  # another driver commits while the base is written
                monkeypatch.setattr(rollup, "put_new", put)
                assert rollup.Rollup(spark, folder).apply("late", spark.createDataFrame([("delete", "a", "en", "t", 1, 10, 1)], CHANGE))
                return put(s, uri, data)

            monkeypatch.setattr(rollup, "put_new", late)
            r.compact()
            want = [("a", "en", "t", 5, 13, 50)]
            assert seen() == want and len(r._state()[2]) == 2
    assert seen() == want
    assert not r.apply("part/1", spark.createDataFrame(rows[1], CHANGE)) and seen() == want
    assert put(spark, f"{folder}/log/x.json", b"1") and not put(spark, f"{folder}/log/x.json", b"2")


def test_tokens_by_vocabulary(spark):
    from tokenizers import Tokenizer

    from sparkrag.llm.sstable import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "Hello  world\n", "a<|endoftext|>b", "word " * 50_000]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = dict(docs.select("doc_id", rollup.vocabulary_tokens("text").alias("n")).collect())
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_revisions(spark):
    rows = spark.createDataFrame([("old", "en", 5, 50, "new", "en", "t", 7, 70)], "old_source string, old_lang string, old_tokens long, old_n_chars long, source string, lang string, tokenizer string, tokens long, n_chars long")
    assert sorted((x.op, x.source, x.tokens) for x in rollup.revised(rows).collect()) == [("delete", "old", 5), ("insert", "new", 7)]


# ---------------------------------------------------------------- licences


def plain_scan(text, c, weights):
    """Lines that the classifier names, one by one: (line number, family, confirmed)."""
    out = []
    for at, line in enumerate((text or "").split("\n")):
        w = licenses._plain_words(line)
        grams = set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        z = [(b + sum(weights[g][k] for g in grams if g in weights) + (c.offset if k == 0 else 0)) / c.temperature for k, b in enumerate(c.bias)]
        total = sum(math.exp(x - max(z)) for x in z)
        k = max(range(1, len(z)), key=lambda i: (z[i], -i))
        if math.exp(z[k] - max(z)) / total >= c.floor and set(w) & set(c.vocabulary):
            cover = 0
            own = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
            for family, t in licenses.templates():
                if family == c.families[k]:
                    runs = {tuple(t[i : i + 3]) for i in range(len(t) - 2)} or {tuple(t)}
                    cover = max(cover, len(own & runs) / len(runs))
            out.append((at, c.families[k], cover >= licenses.COVER))
    return out


@pytest.fixture(scope="module")
def classifier(spark, sf):
    return licenses.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def test_single_lines_agree_with_a_plain_scan(spark, sf, classifier):
    weights = {r.gram: list(r.w) for r in classifier.weights.collect()}
    corpus = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    lines = [x for own in licenses.notices().values() for x in own] + licenses.NEAR_MISSES
    texts = corpus + [(10_000 + i, x) for i, x in enumerate(lines)]
    base, found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), classifier)
    got = {}
    for r in found.join(base, "row").collect():
        got.setdefault(r.doc_id, []).append((r.at, r.family, r.confirmed))
    want = {i: own for i, t in texts if (own := plain_scan(t, classifier, weights))}
    assert {i: sorted(x) for i, x in got.items()} == want
    planted = {i for i, t in corpus if re.search("MIT License|Apache License|General Public License|CC BY-NC|All rights reserved", t or "")}
    assert planted == {i for i, own in want.items() if i < 10_000 and any(ok for _, _, ok in own)}


def test_held_out_notices_are_named(spark, sf):
    classifier = licenses.fit(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), refit=False)
    rows = [(f, x) for f, own in licenses.notices().items() for i, x in enumerate(own) if i % 4 == 0]  # no form of these was learnt from
    base, found = licenses.scan(spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, text string"), classifier)
    named = {r.doc_id: r.family for r in found.join(base, "row").collect()}
    right = sum(named.get(i) == f for i, (f, _) in enumerate(rows))
    assert right / len(rows) > 0.8 and sum(f != named[i] for i, (f, _) in enumerate(rows) if i in named) / len(rows) < 0.1
    assert 0.05 < classifier.temperature < 20 and 0.5 <= classifier.floor < 1


def test_families_are_told_apart(spark, classifier):
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated\ndocumentation files (the Software)"
    texts = {
        "He got his driving license under the Apache tribe version 2.0": None,
        mit: "mit",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "lgpl",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa",
        "Licensed under CC BY 4.0.": "cc-by",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        "Made available under the Eclipse Public License 2.0.": "epl-2.0",
        "Copyright 2021 Some Company. All rights reserved.": "proprietary",
    }
    base, found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), classifier)
    got = {r.doc_id: r.family for r in found.where("confirmed").join(base, "row").collect()}
    assert got == {i: f for i, f in enumerate(texts.values()) if f}


def test_licences(spark, classifier):
    c = classifier
    texts = [
        (1, "Intro.\nReleased under the MIT License.\nThe end."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Licensed under the Apache License, Version 2.0.\n\nLicensed under CC BY-NC 4.0."),
        (4, "He was driving without a license.\nThe apache helicopter landed."),
        (5, None),
        (6, ""),
        (7, "Die Katze schläft.\n" * 3000),
        (1, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, row string, at int").select("doc_id", "text", "row", "at")
    base, found = licenses.scan(docs, c)
    rows = sorted((r.doc_id, r.family, r.confirmed) for r in found.join(base, "row").collect())
    assert rows == [(1, "mit", True), (1, "mit", True), (2, "gpl", True), (3, "apache-2.0", True), (3, "cc-by-nc", True)]
    assert sorted((r.doc_id, r.n_paragraphs) for r in base.collect()) == [(1, 1), (1, 3), (2, 1), (3, 2), (4, 2), (5, 0), (6, 0), (7, 3000)]
    none = licenses.scan(docs.limit(0), c)
    assert none[0].count() == 0 and none[1].count() == 0


def test_wrapped_licences(spark, classifier):
    c = classifier
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."
    narrow = "# This program is free\n# software: you can\n# redistribute it and/or\n# modify it under the\n# terms of the GNU General\n# Public License as\n# published by the Free\n# Software Foundation"
    texts = [(1, f"Intro.\n\n{gpl}\n\nThe end."), (2, f"A line before.\n{bsd}\nA line after."), (3, apache), (4, narrow), (5, f"{bsd}\n\n{bsd}"), (6, f"{gpl}\n\nReleased under the MIT License.\nIt is short."), (7, "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions are met:"), (8, "He was driving without a license.\nThe apache helicopter landed under cover.\nShe studied at MIT and published her work.")]
    base, found = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), c)
    rows = sorted((r.doc_id, r.family) for r in found.where("confirmed").join(base, "row").collect())
    assert [r for r in rows if r[0] in (1, 2, 4, 5, 6)] == [(1, "gpl"), (2, "bsd"), (4, "gpl"), (5, "bsd"), (5, "bsd"), (6, "gpl"), (6, "mit")]
    assert {r for r in rows if r[0] in (3, 7, 8)} == {(3, "apache-2.0")}
    left = {r.doc_id for r in found.where("NOT confirmed").join(base, "row").collect()}
    assert not left & {2, 4, 5}
