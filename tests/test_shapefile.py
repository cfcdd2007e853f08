"""Shapefiles written byte by byte, read by ranges of records."""

import struct

import pytest

from trellisway.sources import shapefile as H

HOOK = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]  # with the clock
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 2.0)]  # against it
ISLAND = [(20.0, 0.0), (20.0, 5.0), (25.0, 0.0), (20.0, 0.0)]


def shape(rings, kind=5):
    points = [p for r in rings for p in r]
    starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
    xs, ys = zip(*points)
    return struct.pack(f"<i4d2i{len(rings)}i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def write(folder, records, rows):
    main, index, at = b"", b"", 50
    for i, body in enumerate(records):
        main += struct.pack(">2i", i + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (folder / "z.shp").write_bytes(head(len(main)) + main)
    (folder / "z.shx").write_bytes(head(len(index)) + index)
    fields = [("id", "N", 8, 0), ("rate", "N", 10, 3), ("name", "C", 6, 0), ("open", "L", 1, 0)]
    described = b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), size, digits) for n, k, size, digits in fields)
    body = b"".join(b" " + b"".join(v.encode().rjust(f[2]) if f[1] == "N" else v.encode().ljust(f[2]) for v, f in zip(r, fields)) for r in rows)
    (folder / "z.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, len(rows), 33 + len(described), 26) + described + b"\r" + body + b"\x1a")
    return str(folder / "z.shp")


@pytest.mark.parametrize("per_task", [2, 50_000])
def test_round_trip(spark, tmp_path, per_task):
    records = [shape([HOOK, HOLE]), struct.pack("<i", 0), shape([ISLAND, HOOK, HOLE]), shape([[(0.0, 0.0), (3.0, 4.0)]], 3), struct.pack("<i2d", 1, 7.0, 8.0)]
    rows = [("1", "1.500", "né", "T"), ("2", "", "b", "?"), ("-3", "-2.250", "", "F"), ("4", "********", "d", "N"), ("", "0.000", "e", "y")]
    path = write(tmp_path, records, rows)
    found = H.read_shapes(spark, path, per_task=per_task)
    assert found.rdd.getNumPartitions() == (3 if per_task == 2 else 1)
    plain = [(r.id, r.rate, r.name, r.open, [[[(p.x, p.y) for p in ring] for ring in part] for part in r.parts or []]) for r in found.collect()]
    assert plain == [
        (1, 1.5, "né", True, [[HOOK, HOLE]]), (2, None, "b", None, []), (-3, -2.25, None, False, [[ISLAND], [HOOK, HOLE]]), (4, None, "d", False, []), (None, 0.0, "e", True, []),
    ]
    lines = {r.id: [(p.x, p.y) for p in r.points or []] for r in H.read_shapes(spark, f"file://{path}", areas=False, per_task=per_task).filter("id = 4 or id is null").collect()}
    assert lines == {4: [(0.0, 0.0), (3.0, 4.0)], None: [(7.0, 8.0)]}
    assert H.read_shapes(spark, path).select("id").filter("id > 0").count() == 3


def test_no_records(spark, tmp_path):
    assert H.read_shapes(spark, write(tmp_path, [], [])).count() == 0
