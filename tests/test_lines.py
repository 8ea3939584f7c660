"""Files read line by line against the same files taken as one row."""

import random
from datetime import datetime
from pathlib import Path

import pytest

from cyclelake.sources import files, lines, profiling

PROFILE = ["delimiter", "brand", "brand_confidence", "is_transposed", "header_row", "unit_row", "data_start", "headers", "units", "row_count"]


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    held = {n: spark.conf.get(n) for n in (name, "spark.sql.files.openCostInBytes")}
    spark.conf.set(name, 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for n, value in held.items():
        spark.conf.set(n, value)


def protocol(seed, rows, ends="\n", head=("Protocole Arburg", "Machine: 152", "Date; 11.02.2025 06:00:00")):
    r = random.Random(seed)
    out = [*head, "f1403;t007;t4012;t4015", "-;h:min;s;s"]
    minutes = 500
    for i in range(rows):
        minutes += r.choice([1, 5, 40, 400])
        clock = "--" if r.random() < 0.1 else f"{minutes // 60 % 24:02d}:{minutes % 60:02d}" + r.choice(["", ":30"])
        row = [str(i), clock, "28,5", "7"]
        out.append(";".join(r.choice([row, row, row[:3], [*row, "extra"]])))
        out += [""] * (r.random() < 0.1)
    return ends.join(out) + ends


def write(folder, texts):
    for name, data in texts.items():
        path = Path(folder) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def rows_of(df, *columns):
    return sorted((tuple(str(r[c]) for c in ("path", *columns)) for r in df.collect()), key=repr)


def plain(path):
    return path.rpartition("/")[2]


TEXTS = {
    "a.txt": protocol(1, 300),
    "crlf.txt": protocol(2, 120, "\r\n"),
    "latin.txt": protocol(3, 150).replace("Arburg", "Arburg très").encode("latin-1"),
    "bom.txt": b"\xef\xbb\xbf" + protocol(4, 40).encode(),
    "far.txt": protocol(5, 60, head=("Protocole Arburg", *[f"note {i}" for i in range(90)], "Presse = 9", "Date; 12.02.2025 06:00:00")),
    "none.txt": "a\nb\nc\n" * 50,
    "one.txt": "x;y;z",
    "turned.csv": "Variable,Cycle1,Cycle2\n" + "x,1,2\n" * 60 + "Time,1,2\nCycle_Time,3,4\n",
    "wide.csv": ",".join(f"v{i}" for i in range(90)) + "\n" + ",".join("1" * 90) + "\n",
    "table.csv": "Time,Machine,Cycle_Time\n" + "".join(f"2026-07-09T12:{i % 60:02d}:00Z,{i},20\n" for i in range(200)),
    "blank.csv": "\n\n\n\n" + "Time,Machine,Cycle_Time\n2026-07-09T12:00:00Z,1,20\n",
}


def test_profiles_and_rows_equal_those_of_whole_files(spark, tmp_path, small_splits):
    folder = write(tmp_path, TEXTS)
    whole = profiling.profile_files(files.read_files(spark, folder)).cache()
    read = lines.read_lines(spark, folder)
    assert read.select("path", "block").distinct().count() > 30
    cut = lines.profile_lines(read).cache()
    want = {plain(r["path"]): r for r in whole.collect()}
    got = {plain(r["path"]): r for r in cut.collect()}
    assert set(got) == set(want)
    for name, row in got.items():
        for column in PROFILE:
            if not (row["is_transposed"] and column in ("headers", "units")):
                assert row[column] == want[name][column], (name, column)
    for reader, columns in (("read_protocol", ("line_no", "cells", "time", "machine_ref")), ("read_table", ("line_no", "cells", "time"))):
        one = [(plain(r[0]), *r[1:]) for r in rows_of(getattr(files, reader)(whole), *columns)]
        many = [(plain(r[0]), *r[1:]) for r in rows_of(getattr(lines, reader)(read, cut), *columns)]
        assert sorted(one) == sorted(many) and len(one) > 700


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    folder = write(tmp_path, {"big.txt": protocol(7, 400)})
    read = lines.read_lines(spark, folder)
    assert read.select("block").distinct().count() > 8
    numbers = sorted(r["line_no"] for r in read.collect())
    assert numbers == list(range(len(TEXTS and protocol(7, 400).split("\n")) - 1))
    rows = lines.read_protocol(read, lines.profile_lines(read))
    days = [r["time"].date() for r in rows.orderBy("line_no").collect() if r["time"]]
    assert days == sorted(days) and len(set(days)) > 20


def test_utf16_files_are_left_to_whole_file_reading(spark, tmp_path):
    folder = write(tmp_path, {"u.txt": protocol(1, 5).encode("utf-16"), "v.txt": protocol(1, 5)})
    assert {plain(r["path"]) for r in lines.read_lines(spark, folder).collect()} == {"v.txt"}


def test_files_are_opened_once(spark, tmp_path):
    """What reads the lines reads a table; the text files may be gone."""
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "a.csv").write_text("a;b;c\n1;2;3\n")
    read = lines.read_lines(spark, f"{tmp_path}/own")
    (tmp_path / "own" / "a.csv").write_text("")
    assert sorted((r.line_no, r.line) for r in read.collect()) == [(0, "a;b;c"), (1, "1;2;3")]


def test_protocol_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from cyclelake.plans import file_queries
    from cyclelake.plans.views import Views

    rows = [(i, i % 5, datetime(2026, 1, 1, i % 24, i % 60), "error" if i % 9 == 0 else "click", float(i), f'{{"k": {i % 40}}}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen, original = [], file_queries.spread
    monkeypatch.setattr(file_queries, "spread", lambda df, *keys: seen.append(original(df, *keys)) or seen[-1])
    path = file_queries._protocols(Views(spark, str(tmp_path)))
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert len(list(Path(path).rglob("part-*.txt"))) == 5


def test_protocol_files_share_folders(spark, tmp_path):
    """No folder per machine; heads come first, rows in time order, each blank line behind its row."""
    from cyclelake.plans import file_queries
    from cyclelake.plans.views import Views

    rows = [(i, i % 2, None if i == 8 else datetime(2026, 1, 1, 23 - i, 0), "click", float(i), f'{{"k": {i + 1}}}') for i in range(12)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    path = Path(file_queries._protocols(Views(spark, str(tmp_path))))
    texts = sorted((p.read_text() for p in path.glob("part=0/part-*.txt")), key=lambda t: "Machine: 1" in t)
    assert len(list(path.rglob("*.txt"))) == len(texts) == 2
    for machine, text in enumerate(texts):
        assert text.endswith("\n")
        found = text[:-1].split("\n")
        head = ["Protocole Arburg", f"Machine: {machine}", "Date; 11.02.2025 06:00:00", "f1403;t007;t4012;t4015;t4018", "-;h:min;s;s;s"]
        assert [x for x in found if x in head] == head
        ids = [i for i in range(11, -1, -1) if i % 2 == machine]
        ids = [8, *(i for i in ids if i != 8)] if 8 in ids else ids  # without a time: with the heads
        body = [x for x in found if x not in head]
        wanted = [x for i in ids for x in ([i, ""] if (i + 1) % 7 == 0 else [i])]
        assert [x and int(x.split(";")[0]) for x in body] == wanted
