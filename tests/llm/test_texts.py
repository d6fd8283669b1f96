import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_nearcopies import slow_groups

from tessera.llm import decontaminate, linededup, mixing, sharding, toxicity, warc
from tessera.llm.common import lookup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


PASSAGE = " ".join(f"Sentence {i} of the passage goes on for a while." for i in range(8))


def slow_spans(rows, least=5, run=20):
    """Units by hand, the first of each digest kept, runs of others of at least ``run`` words."""
    seen, every = {}, []
    for rid, (i, t) in enumerate(rows):
        own = []
        for line in re.finditer(r"[^\n]+", t or ""):
            parts, at = [], line.start()
            for m in re.finditer(r"(?<=[.!?])[ \t]+", line[0]):
                parts.append((at, line.start() + m.start()))
                at = line.start() + m.end()
            parts.append((at, line.end()))
            unit, words = None, []
            for k, (s, e) in enumerate(parts):
                w = t[s:e].lower().split(" ") if t[s:e].strip() else []
                w = t[s:e].lower().split()
                if w:
                    unit = s if unit is None else unit
                    words += w
                if len(words) >= least or k == len(parts) - 1:
                    if words:
                        own.append((unit, e, tuple(words)))
                    unit, words = None, []
        every.append((i, rid, own))
    for i, rid, own in sorted(every, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        for k, (_, _, w) in enumerate(own):
            seen.setdefault(w, (rid, k))
    out = []
    for i, rid, own in every:
        block = []
        for k in range(len(own) + 1):
            if k < len(own) and seen[own[k][2]] != (rid, k):
                block.append(own[k])
            else:
                if sum(len(u[2]) for u in block) >= run:
                    out.append((str(i), block[0][0], block[-1][1], len(block)))
                block = []
    return sorted(out)


def test_repeated_spans(spark):
    rows = [(0, "Some own words that open here. " + PASSAGE + " And the end of it."), (1, "Other. " + PASSAGE), (2, "x\n" + PASSAGE.upper().replace(" ", "  ") + "\ny"), (3, None), (4, ""), (5, " \n "), (6, "short line\nshort line\n" * 3), (1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (7, "word " * 3000), (8, "word " * 3000), (9, "clean text of its own, which nobody else has got in any of the documents here at all, not even in part, so that it has to stay as it is")]
    out = linededup.repeated_spans(docs(spark, rows), least=5, run_words=20, breaks=linededup._BREAK).collect()
    assert sorted((str(r.doc_id), r.start, r.end, r.n_units) for r in out) == slow_spans(rows)
    assert {r.kept_doc_id for r in out if r.doc_id in (1, 2)} == {0}
    cleaned = {(r.doc_id): r for r in linededup.remove_spans(docs(spark, rows), passages=True).collect()}
    assert cleaned[9].text == rows[-1][1] and cleaned[9].removed is None and cleaned[3].text is None
    assert cleaned[2].text == "x\n\ny" and cleaned[8].text.strip() == ""
    assert linededup.repeated_spans(docs(spark, rows).filter("false")).count() == 0


def test_short_repeats_are_reported(spark, tmp_path):
    line = "A line of just seven short words"
    cut = "end within a sentence that opened before. Twelve words stand in this sentence and it is whole there. " + " ".join(f"w{i}" for i in range(40))
    rows = [(0, f"Own {line}\n{line}\nx zero {cut} zero"), (1, f"{line}\ny one {cut} one")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in linededup.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert spans(rows, out) == [(1, line, False), (1, "Twelve words stand in this sentence and it is whole there.", True)]
    assert [(out[i].n_hit, out[i].n_repeated) for i in (0, 1)] == [(0, 0), (11, 18)]  # equal words stand on both sides of the long one


def spans(rows, out):
    """(doc_id, text, whether it is a passage) of the spans that op3 reports."""
    texts = {i: (t or "").encode() for i, t in rows}
    found = [(i, *re.fullmatch(r"(\d+)-(\d+):.*?(\*?)", x).groups()) for i, r in out.items() for x in r.spans.split()]
    return sorted((i, texts[i][int(a) : int(b)].decode(), bool(star)) for i, a, b, star in found)


def test_units_do_not_depend_on_the_text_before(spark, tmp_path):
    passage = "Dies ist ein Satz, " + "der lange weiter geht, " * 15 + "bis er endet."
    signs = "and this sentence here ends in signs.%%%"
    quote = 'And \u201cthis one ends in a quote.\u201d'
    rows = [(0, f"Es. {passage}\nzero {signs} {quote} {signs} zero"), (1, f"Anders. {passage} Ja\none {signs} {quote} {signs} one")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in linededup.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert {x[:2] for x in spans(rows, out)} == {(1, passage), (1, f"{quote} {signs}")}


def test_line_dedup_has_a_row_for_each_document(spark, tmp_path):
    rows = [(3, None), (4, ""), (5, " \n"), (6, "alone"), (6, "alone"), (None, "alone")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = linededup.op3_line_dedup(spark, str(tmp_path)).collect()
    assert sorted(((str(r.doc_id), r.n_hit, r.n_words, r.n_repeated, r.spans) for r in out)) == [("3", 0, 0, 0, ""), ("4", 0, 0, 0, ""), ("5", 0, 0, 0, ""), ("6", 0, 1, 0, ""), ("6", 0, 1, 1, "0-5:6:1"), ("None", 0, 1, 1, "0-5:6:1")]
    assert linededup.report(docs(spark, rows).filter("false")).count() == 0
    whole = linededup.remove_spans(docs(spark, rows)).collect()
    assert sorted(map(str, (r.text for r in whole))) == sorted(map(str, (None, "", " \n", "alone", "", "")))


def test_archives_round_trip(spark, tmp_path):
    pages = [(3, "http://a/x y\n", "<p>é</p>" * 9000), (1, None, "same"), (2, "http://b", "same"), (2, "http://b", "same"), (4, "", None), (5, "u", ""), (None, "n", "same"), (6, "u", "WARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u", "<p>é</p>" * 9000)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, digest string, rid string")
    for least, segment in ((0, 1000), (5, 1 << 20)):
        path = str(tmp_path / f"w{least}")
        warc.write_archives(df, path, min_dedup=least, segment_bytes=segment)
        out = warc.read_archives(spark, path).collect()
        assert len(out) == len(pages)
        first = {}
        for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
            if len((h or "").encode()) >= least:
                first.setdefault(h or "", i)
        want, told = [], set()
        for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
            data = (h or "").encode()
            again = (h or "") in told and len(data) >= least
            told.add(h or "")
            want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, None if again else data))
        got = [(str(r.page_id), r.len, r.digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out]
        assert sorted(got, key=str) == sorted(want, key=str)
        data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / f"w{least}").glob("*.gz"))
        kinds = [h["WARC-Type"] for h, _ in warc.parse(data)]
        assert ("continuation" in kinds) == (segment == 1000)


def archive(*records):
    return b"".join(b"WARC/1.0\r\n" + head + b"Content-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block) for head, block in records)


def test_archives_of_others_and_damaged_ones(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\n\r\n"
    ok = (b"warc-type: response\r\nWARC-RECORD-ID: <a>\r\nX-Long: a\r\n b\r\n", http + b"body")
    info, plain = (b"WARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\n", b"x: y"), (b"WARC-Type: revisit\r\nWARC-Record-ID: <r>\r\nWARC-Payload-Digest: md5:00\r\n", http)
    (tmp_path / "a.warc").write_bytes(archive(info, ok, plain))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(archive(info)) + gzip.compress(archive(ok)))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, r.len, r.page_id, r.error) for r in got if r.record_type == "response") == [("response", 4, None, None)] * 2
    assert [(r.len, r.payload) for r in got if r.record_type == "revisit"] == [(None, None)]
    broken = {
        "cut": gzip.compress(archive(ok))[:-20], "nolength": b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", "badlength": b"WARC/1.0\r\nContent-Length: ten\r\n\r\n", "nocolon": b"WARC/1.0\r\nnothing\r\n\r\n", "open": b"WARC/1.0\r\nA: b",
        "noid": archive((b"WARC-Type: response\r\n", http)), "notype": archive((b"WARC-Record-ID: <x>\r\n", http)), "page": archive((ok[0] + b"X-Page-Id: p\r\n", ok[1])), "digest": archive((ok[0] + b"WARC-Payload-Digest: sha1:AAAA\r\n", ok[1])),
        "nohttp": archive((ok[0], b"body")), "bytes": b"WARC/1.0\r\n\xff\xfe\r\n\r\n", "rubbish": b"\x1f\x8bnot gzip", "part": archive((ok[0] + b"WARC-Segment-Number: 2\r\n", http)),
    }
    for name, data in broken.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc").write_bytes(archive(ok) + data if data[:2] != b"\x1f\x8b" else data)
        kinds = sorted(r.record_type for r in warc.read_archives(spark, str(folder), errors="keep").collect())
        assert "damaged" in kinds and ("response" in kinds or name in ("cut", "rubbish", "part")), name
    with pytest.raises(Exception, match="broken compression"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()


def test_broken_archives_raise():
    with pytest.raises(warc.WarcError):
        warc.reassemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(warc.WarcError):
        warc.reassemble([(1, None, b"a"), (2, 3, b"b")])
    with pytest.raises(warc.WarcError):
        warc.reassemble([(1, None, b"a")])
    assert warc.reassemble([(2, 2, b"b"), (1, None, b"a")]) == b"ab"
    for body in (b"5\r\nabc\r\n0\r\n\r\n", b"x\r\n", b"3\r\nabc", b"3\r\nabc\r\n"):
        with pytest.raises(warc.WarcError):
            warc.dechunked(body)
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    for size in (1, 3, 100):
        assert warc.dechunked(warc.chunked(b"0\r\n\r\nabc" * 20, size)) == b"0\r\n\r\nabc" * 20
    with pytest.raises(warc.WarcError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_lookup_keeps_every_row(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else cast(id as string) end k")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = lookup(rows, groups.filter("k != '5'"), "k", "n", "id", 5000).toPandas()
    assert len(out) == 5000 and out.id.is_unique
    assert out.least.isna().sum() == (out.k.isna() | (out.k == "5")).sum()


def test_pipeline_stages_against_their_operators(spark, tmp_path):
    item = " ".join(f"leak{i}" for i in range(15))
    base = [(i, " ".join(f"w{i}x{k}" for k in range(40)) + f"\nline {i}") for i in range(60)]
    rows = [*base, (100, base[0][1]), (101, base[0][1].replace("w0x20", "zz")), (103, base[2][1].replace("w2x0 ", "")), (104, base[2][1].replace("w2x39", "").replace("w2x38", "")), (102, f"before {item} after"), *[(200 + i, f"a{i} b{i} vile rotten c{i} d{i}") for i in range(20)], (300, None), (301, ""), (None, "no id"), (1, base[1][1])]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i is not None and 200 <= i < 300)) for i, _ in rows if i is None or i != 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = (now, stage(spark, now, str(tmp_path)))
        if name != "sharding":
            assert frames[name][1].columns == now.columns
            frames[name][1].write.parquet(str(tmp_path / f"s-{name}"))
            now = spark.read.parquet(str(tmp_path / f"s-{name}"))
            frames[name] = (frames[name][0], now)
    ids = {k: ({r.doc_id for r in a.collect()}, sorted((r.doc_id for r in b.collect()), key=str)) for k, (a, b) in frames.items()}
    assert set(ids["toxicity"][1]) == {i for i, _ in rows if i is None or not 200 <= i < 300}
    before = frames["near_duplicates"][0]
    groups = slow_groups([(r.doc_id, r.text) for r in before.collect()])  # all pairs of shingle sets
    kept = ids["near_duplicates"][1]
    assert sorted((i for i in kept if i is not None)) == sorted({c for i, c in groups if i != "None"}) and None in kept
    assert 100 not in kept and kept.count(1) == 1
    before = frames["decontamination"][0]
    dirty = {r.doc_id for r in decontaminate.contamination(before, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect() if r.hits}
    assert dirty == {102} and set(ids["decontamination"][1]) == ids["decontamination"][0] - {102}
    assert set(ids["mixing"][1]) == {r.doc_id for r in mixing.sample(frames["mixing"][0]).collect()}
    assert set(ids["sharding"][1]) == ids["sharding"][0]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole.collect() if r.doc_id is not None) == sorted((r.doc_id, r.shard, r.slot) for r in frames["sharding"][1].collect() if r.doc_id is not None)
    assert toxicity.REJECT_AT == 0.5 and sharding.N_SHARDS == 24
