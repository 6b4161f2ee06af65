"""The divergence audit, the filter audit and the archives: odd tables beside their SQL, and the archives' bytes."""

import hashlib
import random
import struct

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import contract_sql, divergence, filter_audit, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, docs int, digest string, part string, value string, subset int"
PAGES = "page_id long, url string, html string, payload string, first long, digest string, archive int"


def by_sql(tmp_path, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), sorted(({k: v for k, v in zip(found.columns, r, strict=True)} for r in found.fetchall()), key=str)


def same_rows(got, wanted):
    columns, rows = wanted
    assert sorted(got.columns) == columns
    key = lambda r: str([r[c] for c in columns])
    assert sorted(([r[c] for c in columns] for r in got.collect()), key=str) == sorted(([r[c] for c in columns] for r in rows), key=str)


def odd_documents(rng, n=160):
    alphabet = ["alpha", "Beta", "BETA", "gamma#", "été", "Éte", "x1y", "naïve word", "中文", "LOUD", "a|b", "10%", "\t", "o'clock"]
    rows = []
    for k in range(n):
        words = [rng.choice(alphabet[: rng.randint(1, len(alphabet))]) for _ in range(rng.choice([0, 1, 30, 250, 400]))]
        rows.append([k, " ".join(words), rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "s3", "", None])])
    rows += [list(r) for r in rows[:30]]  # repeated rows
    rows += [[900 + k, r[1], "fr", r[3]] for k, r in enumerate(rows[:25])]  # copies in another part
    rows += [[None, r[1], r[2], r[3]] for r in rows[:12]] + [[None, None, None, None], [77, None, "en", "only"], [78, "", "xx", "s1"], [79, "one two", "xx", "s2"], [80, "Word " * 90_000, "en", "s1"], [81, "W" * 300_000, "en", "s1"], [5, "another text of an id that repeats", "en", "s9"]]
    return [(*r, 1, 2, 3, "d", "p", "v", 4) for r in rows]


def test_divergence_equals_sql(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(odd_documents(random.Random(1)), DOCS).repartition(3)
    wanted = by_sql(tmp_path, contract_sql.DIVERGENCE_SQL, documents=docs)
    for sources, terms, held in ((64, 512, 100_000), (2, 3, 5)):
        monkeypatch.setattr(divergence, "SOURCES", sources)
        monkeypatch.setattr(divergence, "TERMS", terms)
        monkeypatch.setattr(divergence, "HELD", held)
        same_rows(divergence.audit(docs), wanted)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_divergence_of_many_sources(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", *(f"w{i}" for i in range(300))], k=30)).replace("1", "x").replace("2", "y"), "en", f"s{rng.randint(0, 150)}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    same_rows(divergence.audit(docs), by_sql(tmp_path, contract_sql.DIVERGENCE_SQL, documents=docs))


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(F.lit(3 * 10**13).alias("n"), F.lit(10**14).alias("total"), F.lit(7).cast("long").alias("kept")).select(F.expr(divergence._share("n", "total")).alias("p"), F.expr(divergence._difference("1000000001L", "1L")).alias("f")).first()
    assert (row["p"], row["f"]) == (1 + 10**9 * (3 * 10**13 + 1) // (10**14 + 7), 10**18)


def test_filters_equal_sql(spark, tmp_path):
    docs = spark.createDataFrame(odd_documents(random.Random(3)), DOCS).repartition(3)
    labels = [(k, k % 3 % 2, int(k % 7 == 0)) for k in range(0, 120, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9, None, None), (5000, 1, 1), (6, 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks)
    same_rows(got, by_sql(tmp_path, contract_sql.FILTERS_SQL, documents=docs, labels=marks))
    parts = docs.select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert got.count() == parts * 600
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert {r["good_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


def test_each_step_of_the_filters(spark):
    """Copies of a removed text still count as copies; a document that fails two filters is removed once."""
    rows = [(2, "a b", "en"), (1, "a b", "de"), (3, " ".join(f"w{k}" for k in range(200)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    found = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    first, second = found["en", "AEBCD", 1], found["en", "AEBCD", 2]
    assert (first["kept"], first["removed"], first["redundant"], first["unique_fails"], first["good_lost"], first["toxic_lost"]) == (1, 1, 0, 0, 1, 1)
    assert (second["kept"], second["removed"], second["redundant"], second["shapley"]) == (1, 0, 1, 60)
    assert (found["de", "EABCD", 1]["removed"], found["de", "EABCD", 2]["unique_fails"]) == (0, 1)


def odd_pages(rng):
    body = ["<p>" + " ".join(rng.choices(["news", "of", "the", "day", "été", "中"], k=rng.choice([0, 3, 60, 400]))) + "</p>" for _ in range(40)]
    rows = [(k, f"http://site{k % 5}.org/p/{k}", rng.choice(body)) for k in range(300)]
    rows += rows[:20] + [(400, None, None), (401, "", ""), (402, "http://x/\r\nWARC-Type: revisit\r\n\r\n", "x" * 99), (403, "http://y/é %41", "x" * 99), (404, "u", "x" * 100), (405, "u", "x" * 100)]
    rows += [(None, "n", "x" * 100), (None, None, "only without an id " * 9), (None, "", "only without an id " * 9), (406, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (407, "u", "long é " * 400_000), (500, "u", None)]
    return [(*r, "p", 3, "d", 1) for r in rows]


def test_archives_read_back(spark, tmp_path):
    pages = spark.createDataFrame(odd_pages(random.Random(4)), PAGES).repartition(5)
    wanted = by_sql(tmp_path, contract_sql.ARCHIVES_SQL, pages=pages)
    same_rows(warc.write_and_read(spark, pages, f"{tmp_path}/one"), wanted)
    small = warc.write(pages, f"file://{tmp_path}/two", archive_bytes=10_000)
    assert small.count() > 20
    # What a lost attempt leaves behind isn't named, so that it isn't read.
    (tmp_path / "two" / "left.warc.zst").write_bytes(warc.packed([warc.page_record(1, "u", b"x", None, "d")]))
    same_rows(warc.read(small, f"file://{tmp_path}/two").select(*wanted[0]), wanted)
    assert warc.write_and_read(spark, pages.limit(0), f"{tmp_path}/three").collect() == []


def test_an_archive_by_its_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<html><body>page {k} of many pages that are alike {k * 7919}</body></html>" * 3) for k in range(300)] + [(1000, "http://a/again", f"<html><body>page 3 of many pages that are alike {3 * 7919}</body></html>" * 3)], "page_id long, url string, html string").coalesce(1)
    names = warc.write(pages, str(tmp_path / "w"), date="2020-02-02T00:00:00Z").collect()
    assert [r["records"] for r in names] == [301]
    data = (tmp_path / "w" / names[0]["archive"]).read_bytes()
    assert len(data) == names[0]["archive_bytes"]
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    trained = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert trained[:4] == b"\x37\xa4\x30\xec"
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[8 + size :])
    assert b"WARC-Type: warcinfo" in plain.decompress(data[8 + size :])
    records = list(warc.frames(iter([data[i : i + 1000] for i in range(0, len(data), 1000)])))
    assert len(records) == 302 and records[1].count(b"WARC/1.1") == 1
    alone = sum(len(zstandard.ZstdCompressor(level=6).compress(r)) for r in records)
    assert len(data) - size < 0.8 * alone
    pages_by_id = {h.get("Page-ID"): (h, block) for h, block in map(warc.parsed, records)}
    headers, block = pages_by_id["1000"]
    assert headers["WARC-Type"] == "revisit" and headers["WARC-Refers-To"] == pages_by_id["3"][0]["WARC-Record-ID"] and headers["WARC-Date"] == "2020-02-02T00:00:00Z"
    assert block.endswith(b"\r\n\r\n") and f"Content-Length: {len(pages.where('page_id = 3').first()['html'])}".encode() in block
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(iter([data[:-3]])))


def test_a_changed_payload_is_noticed():
    record = warc.page_record(1, "u", b"payload", None, "d")
    assert warc.page_row(record)["payload_digest"] == hashlib.sha256(b"payload").hexdigest()
    with pytest.raises(ValueError, match="not as it was written"):
        warc.page_row(record.replace(b"payload\r\n\r\n", b"pay-oad\r\n\r\n"))
    with pytest.raises(ValueError, match="no record"):
        warc.page_row(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError, match="as long as it says"):
        warc.page_row(record[:-1])
