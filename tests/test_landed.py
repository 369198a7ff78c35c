"""Landed files: archives by range, charsets, published cells, catalogues, logs and writers."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import places
from tallyworks.sources import archives, readers, sinks


def archive(path, members, how=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, body in members.items():
            z.writestr(name, body)


def joined(df):
    parts = {}
    for r in df.collect():
        parts.setdefault((r["archive"].rsplit("/", 1)[-1], r["member"]), {})[r["part"]] = bytes(r["content"])
    return {k: b"".join(v[i] for i in range(len(v))) for k, v in parts.items()}


def test_members_by_range(spark, tmp_path):
    rng = random.Random(3)
    bodies = {f"{i:018}_public.xml": rng.randbytes(rng.randint(0, 3000)) * rng.randint(1, 40) for i in range(60)} | {"big_public.xml": b"<x/>" * 700_000, "none.txt": b"no"}
    archive(tmp_path / "a.zip", bodies)
    archive(tmp_path / "b.ZIP", {"s_public.xml": b"stored" * 5000, "empty_public.xml": b""}, zipfile.ZIP_STORED)
    (tmp_path / "c.txt").write_text("no archive")
    got = archives.zip_members(spark, str(tmp_path), r".*_public\.xml", partBytes=10_000, taskBytes=9_000)
    assert got.rdd.getNumPartitions() > 5 and max(len(r["content"]) for r in got.collect()) <= 10_000
    want = {("a.zip", n): b for n, b in bodies.items() if n != "none.txt"} | {("b.ZIP", "s_public.xml"): b"stored" * 5000, ("b.ZIP", "empty_public.xml"): b""}
    assert joined(got) == want
    assert archives.zip_members(spark, f"file://{tmp_path}/a.zip", "nothing").collect() == []


def test_members_that_cannot_be_read(spark, tmp_path):
    raw = io.BytesIO()
    archive(raw, {"a.xml": b"text" * 100, "b.xml": b"more" * 100})
    body = raw.getvalue()
    at = body.rindex(b"PK\x01\x02")  # the second member's entry in the directory
    (tmp_path / "d.zip").write_bytes(body[: at + 10] + b"\x09\x00" + body[at + 12 :])
    with pytest.raises(Exception, match="Deflate64"):
        archives.zip_members(spark, str(tmp_path / "d.zip")).collect()
    rows = {r["member"]: r for r in archives.zip_members(spark, str(tmp_path / "d.zip"), mode="keep").collect()}
    assert rows["a.xml"]["error"] is None and rows["b.xml"]["content"] is None and "method 9 (Deflate64)" in rows["b.xml"]["error"]
    broken = bytearray(body)
    broken[40] ^= 255
    (tmp_path / "e.zip").write_bytes(bytes(broken))
    with pytest.raises(Exception):  # noqa: B017
        archives.zip_members(spark, str(tmp_path / "e.zip"), mode="keep").collect()


def test_charsets_file_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("CCN,NAME\n1,Café ¿\n".encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("CCN,NAME,MORE\n2,Café “¿”,x\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"CCN,NAME\n3,plain\n")
    got = readers.csv_of_any_charset(spark, str(tmp_path))
    assert {(r["CCN"], r["NAME"], r["MORE"]) for r in got.collect()} == {("1", "Café ¿", None), ("2", "Café “¿”", "x"), ("3", "plain", None)}


def test_catalogue_and_log(spark, tmp_path):
    entry = lambda title, end, modified: {"title": title, "modified": modified, "temporal": [{"startDate": "2024-01-01", "endDate": end}], "distribution": [{"mediaType": "application/json", "downloadURL": "j"}, {"mediaType": "text/csv", "downloadURL": f"u{modified}"}]}
    (tmp_path / "data.json").write_text(json.dumps({"dataset": [entry("Hospital Enrollments : 2024", "2024-12-31", "2025-01-02"), entry("Hospital Enrollments : 2025", "2025-12-31", "2026-01-02"), entry("Other : 1", "2026-12-31", "2026-02-01")]}))
    got = readers.dataset_versions(spark.read.json(str(tmp_path / "data.json"), multiLine=True), "hospital enrollments").collect()
    assert [(r["url"], r["vintage"]) for r in got] == [("u2026-01-02", "2024-01-01 to 2025-12-31, file of 2026-01-02"), ("u2025-01-02", "2024-01-01 to 2024-12-31, file of 2025-01-02")]
    (tmp_path / "log.jsonl").write_text('{"provider": "a", "usd": "1.5"}\nbad\n{"provider": "b"}\n')
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "provider string, usd string").collect()] == [("a", "1.5"), (None, None), ("b", None)]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "log.jsonl"), "provider string, usd string", strict=True).collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "x\x00y"), ("b", "2", "")], "k string, n string, t string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["t", "k"])
    text = next((tmp_path / "csv").glob("part-*")).read_text().replace("\x00", "")
    assert text.splitlines()[0] == "t,k" and sorted(text.splitlines()[1:]) == sorted(["xy,a", ",b"])
    sinks.write_json_by(df, str(tmp_path / "json"), "k")
    assert sorted(p.name for p in (tmp_path / "json").iterdir() if p.is_dir()) == ["k=a", "k=b"]
    sinks.replace_table(df, str(tmp_path / "table"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {("a", None, "xy"), ("b", "2", "")}
    sinks.append_new_documents(spark.read.parquet(str(tmp_path / "table")), spark.createDataFrame([("b", "9", "z"), ("c", "1", "z"), ("c", "1", "z")], df.schema), "k", str(tmp_path / "table"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == ["a", "b", "c"]


def test_names_of_states(spark):
    assert spark.createDataFrame([("MA",), ("XX",)], "s string").select(places.name_of(F.col("s"))).collect() == [("massachusetts",), (None,)]
