import json
import os

import oracle
import pytest
from test_ticks import BEGIN, all_kinds, line, walk

from tidemark import cli
from tidemark.errors import DataError, FileError, UsageError
from tidemark.functions.time import parse_iso
from tidemark.operators.flow import flow
from tidemark.schema import DAY_NS
from tidemark.sinks import store
from tidemark.sources.synthetic import synthetic_ticks
from tidemark.sources.ticks import measured, scan

TEXT = all_kinds(100)
N = len(TEXT.splitlines())
DAYS = ("2031-05-31", "2031-06-01")
WHOLE = ("--from", "2031-05-30T00:00:00Z", "--to", "2031-06-03T00:00:00Z")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    (base / "es.txt").write_text(TEXT)
    store.import_text(spark, str(base / "es.txt"), str(base / "column"), "ESZ26")
    store.convert_rows(spark, str(base / "column"), str(base / "row"), "ESZ26")
    return base


def copied(data, tmp_path):
    import shutil

    shutil.copytree(data / "column", tmp_path / "column")
    return tmp_path / "column"


def test_published_data(spark, data):
    m = json.loads((data / "column/ESZ26/_manifest.json").read_text())
    assert m["record_count"] == N
    assert [d["name"] for d in m["partitions"]] == [f"day={d}" for d in DAYS]
    assert store.verify(spark, str(data / "column"), "ESZ26") == {"contract": "ESZ26", "record_count": N}
    assert store.verify(spark, str(data / "row"), "ESZ26")["record_count"] == N


def test_modes_agree(spark, data):
    begin, end = parse_iso(BEGIN), parse_iso("2031-06-01T00:00:00.000000001Z")
    want = oracle.flow(oracle.ticks(TEXT), begin, end)
    for mode, root in (("row", "row"), ("column", "column"), ("pruned", "column")):
        (got,) = flow(scan(spark, str(data / root), "ESZ26", begin, end, "flow", mode).ticks, "ESZ26").collect()
        assert tuple(got)[1:7] == want[:6]


def test_pruning(spark, data):
    begin, end = parse_iso("2031-06-01T00:00:00Z"), parse_iso("2031-06-01T01:00:00Z")
    source = scan(spark, str(data / "column"), "ESZ26", begin, end, "summary")
    plan = source.ticks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "GreaterThanOrEqual(timestamp_ns" in plan
    with measured(spark) as read:
        n = len(source.ticks.collect())
    stats = source.statistics(read, n)
    assert (stats["files_examined"], stats["blocks_examined"], stats["blocks_skipped"], stats["rows_decoded"], stats["rows_selected"]) == (2, 2, 1, 18, 18)
    assert stats["bytes_requested"] > 0
    whole = scan(spark, str(data / "column"), "ESZ26", begin, end, "summary", "column")
    assert "GreaterThanOrEqual(timestamp_ns" not in whole.ticks._jdf.queryExecution().executedPlan().toString()
    with measured(spark) as read:
        whole.ticks.collect()
    assert (whole.statistics(read, 18)["rows_decoded"], whole.statistics(read, 18)["blocks_skipped"]) == (N, 0)


def test_blocks_are_the_row_groups_of_the_files(spark, tmp_path):
    import pyarrow.parquet as pq

    ticks = synthetic_ticks(spark, 200_000, 1, step_ns=DAY_NS // 60_000)
    store.write_days(ticks, str(tmp_path / "d"), in_order=True)
    found = {(str(r.day), r.file, r.block): (r.rows, r.first_ns, r.last_ns) for r in store.blocks(store.load(spark, str(tmp_path / "d"))).collect()}
    want = {}
    for f in (tmp_path / "d").glob("day=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for k in range(meta.num_row_groups):
            times = next(c for c in map(meta.row_group(k).column, range(meta.num_columns)) if c.path_in_schema == "timestamp_ns").statistics
            want[f.parent.name[4:], f.name, k] = (meta.row_group(k).num_rows, times.min, times.max)
    assert found == want
    assert max(k for _, _, k in want) >= 1


def test_refusals(spark, data, tmp_path):
    with pytest.raises(FileError):
        store.import_text(spark, str(data / "es.txt"), str(data / "column"), "ESZ26")
    with pytest.raises(UsageError):
        store.import_text(spark, str(data / "es.txt"), str(tmp_path), "XX")
    (tmp_path / "bad.txt").write_text(TEXT + "\nbad")
    with pytest.raises(DataError, match=f"bad.txt:{N + 1}: "):
        store.import_text(spark, str(tmp_path / "bad.txt"), str(tmp_path / "out"), "ESZ26")
    (tmp_path / "empty.txt").write_text("")
    with pytest.raises(DataError):
        store.import_text(spark, str(tmp_path / "empty.txt"), str(tmp_path / "out"), "ESZ26")
    assert os.listdir(tmp_path / "out") == []


def test_source_that_changes(spark, data, tmp_path, monkeypatch):
    (tmp_path / "es.txt").write_text(TEXT)
    wrote = store.write_days

    def writes(ticks, path, **more):
        wrote(ticks, path, **more)
        (tmp_path / "es.txt").write_text(TEXT + "\n")

    monkeypatch.setattr(store, "write_days", writes)
    with pytest.raises(DataError, match="changed"):
        store.import_text(spark, str(tmp_path / "es.txt"), str(tmp_path / "out"), "ESZ26")
    assert os.listdir(tmp_path / "out") == []


def damage_bytes(root):
    (file,) = (root / "ESZ26/day=2031-06-01").glob("*.parquet")
    raw = bytearray(file.read_bytes())
    raw[40] ^= 1
    file.write_bytes(raw)
    for sidecar in file.parent.glob(".*.crc"):
        sidecar.unlink()


def damage_length(root):
    (file,) = (root / "ESZ26/day=2031-06-01").glob("*.parquet")
    file.write_bytes(file.read_bytes()[:100])
    for sidecar in file.parent.glob(".*.crc"):
        sidecar.unlink()


def damage_day(root):
    import shutil

    shutil.rmtree(root / "ESZ26/day=2031-06-01")


def extra_day(root):
    (root / "ESZ26/day=2031-06-02").mkdir()


def manifest_of(text):
    def damage(root):
        (root / "ESZ26/_manifest.json").write_text(text)
        (root / "ESZ26/._manifest.json.crc").unlink(missing_ok=True)

    return damage


def other_count(root):
    path = root / "ESZ26/_manifest.json"
    m = json.loads(path.read_text())
    m["record_count"] += 1
    m["partitions"][0]["record_count"] += 1
    manifest_of(json.dumps(m))(root)


def changed(change):
    def damage(root):
        m = json.loads((root / "ESZ26/_manifest.json").read_text())
        change(m)
        manifest_of(json.dumps(m))(root)

    return damage


no_days = changed(lambda m: m.update(partitions=[], record_count=0))
half_a_character = changed(lambda m: m.update(source_name="\udc00"))
two_days_alike = changed(lambda m: m["partitions"].append(m["partitions"][0]))


@pytest.mark.parametrize("damage", [damage_bytes, damage_length, damage_day, extra_day, other_count, manifest_of("null"), manifest_of('{"schema_version": 1,'), manifest_of('{"a": 1, "a": 2}'), manifest_of("[" * 40 + "]" * 40), manifest_of('{"a": NaN}'), no_days, half_a_character, two_days_alike])
def test_damage_is_found(spark, data, tmp_path, damage, capsys):
    root = copied(data, tmp_path)
    damage(root)
    assert cli.run(["verify", "--data", str(root), "--contract", "ESZ26"], spark) == 3


def test_command_line(spark, data, tmp_path, capsys):
    q = lambda *more, kind="summary", mode="column": cli.run(["query", kind, "--data", str(data / mode), "--contract", "ESZ26", *WHOLE, *more], spark)
    assert q() == 0
    assert capsys.readouterr().out.splitlines() == ["contract,record_count,volume_contracts,min_price,max_price,vwap", f"ESZ26,{N},99,0.25,8.00,{float(oracle.summary(oracle.ticks(TEXT), 0, 1 << 62)[4]):.17g}"]
    out, stats = str(tmp_path / "o.csv"), str(tmp_path / "s.json")
    assert q("--bucket", "1m", "--output", out, "--stats", stats, kind="bars") == 0
    assert len(open(out).read().splitlines()) == 3
    assert json.load(open(stats))["rows_selected"] == N
    assert q("--bucket", "1m", "--output", out, kind="bars") == 4  # exists
    assert q(kind="bars") == 2
    assert q("--bucket", "1m") == 2
    assert q("--bucket", "2m", kind="bars") == 2
    assert q("--scan-mode", "row") == 2  # of the column layout
    assert q("--scan-mode", "row", mode="row") == 0
    assert q(mode="row") == 2
    assert q("--nonsense", "1") == 2
    assert q("--output", out + "2", "--stats", out + "2") == 2
    assert cli.run(["query", "summary", "--data", str(data), "--contract", "ESZ26", "--from", "2031-06-01T00:00:00Z", "--to", "2031-06-01T00:00:00Z"], spark) == 2
    assert cli.run(["verify", "--data", str(data / "column")], spark) == 2
    assert cli.run(["verify", "--data", str(data / "nowhere"), "--contract", "ESZ26"], spark) == 4
    assert cli.run(["nothing"], spark) == 2
    assert cli.run([], spark) == cli.run(["--help"], spark) == cli.run(["--version"], spark) == 0
    assert sorted(os.listdir(tmp_path)) == ["o.csv", "s.json"]


def test_import_fills_an_empty_folder_only(spark, data, tmp_path, capsys):
    staging = tmp_path / "s"
    run = lambda: cli.run(["import", "--input", str(data / "es.txt"), "--contract", "ESZ26", "--output", str(staging)], spark)
    assert run() == 4
    staging.mkdir()
    assert run() == 0
    assert json.loads(capsys.readouterr().out)["record_count"] == N
    assert sorted(p.name for p in staging.iterdir() if p.name.startswith("day")) == [f"day={d}" for d in DAYS]
    assert run() == 4
    assert cli.run(["import", "--input", str(data / "es.txt"), "--contract", "ESZ26"], spark) == 2


def test_row_copy_of_another_length(spark, data, tmp_path):
    import shutil

    shutil.copytree(data / "row", tmp_path / "row")
    for f in (tmp_path / "row/ESZ26/day=2031-06-01").glob("*.csv"):
        f.write_text("".join(f.read_text().splitlines(True)[1:]))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert cli.run(["query", "summary", "--data", str(tmp_path / "row"), "--contract", "ESZ26", *WHOLE, "--scan-mode", "row"], spark) == 3


def test_parent_that_changes(spark, data, tmp_path, monkeypatch):
    root, load, seen = copied(data, tmp_path), store.load, []

    def loads(spark, path, layout="column"):
        seen.append(path)
        if len(seen) == 3:  # what is read after the copy
            damage_day(root)
        return load(spark, path, layout)

    monkeypatch.setattr(store, "load", loads)
    with pytest.raises(DataError):
        store.convert_rows(spark, str(root), str(tmp_path / "out"), "ESZ26")
    assert os.listdir(tmp_path / "out") == []


def test_overflow_leaves_nothing(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("\n".join(line(parse_iso(BEGIN), "9", "8", "9", v) for v in ((1 << 64) - 1, 1)))
    assert cli.run(["import", "--input", str(tmp_path / "t.txt"), "--contract", "NQZ26", "--data", str(tmp_path / "d")], spark) == 0
    for kind, more in (("summary", []), ("flow", []), ("bars", ["--bucket", "1m"])):
        assert cli.run(["query", kind, "--data", str(tmp_path / "d"), "--contract", "NQZ26", *WHOLE, *more, "--output", str(tmp_path / "o")], spark) == 5
    assert not [x for x in os.listdir(tmp_path) if x.startswith("o")]


def test_layout_of_files_does_not_matter(spark, tmp_path):
    (tmp_path / "t.txt").write_text(walk(2, 5000))
    store.import_text(spark, str(tmp_path / "t.txt"), str(tmp_path / "d"), "ESZ26")
    begin, end = parse_iso(BEGIN), parse_iso(BEGIN) + DAY_NS
    ticks = scan(spark, str(tmp_path / "d"), "ESZ26", begin, end, "bars").ticks
    from tidemark.operators.bars import bars

    want = bars(ticks, "1s").collect()
    for n in (1, 2, 7):
        ticks.repartition(n).write.parquet(str(tmp_path / f"n{n}"))
        assert bars(spark.read.parquet(str(tmp_path / f"n{n}")), "1s").collect() == want
