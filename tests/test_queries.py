import zlib

import pytest
from terrafold.plans import catalogue

from tests.oracle import connect, difference

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.collect()  # all columns


def test_png_tiles_hold_the_pixels(spark, sf_dir):
    rgba = {r.tile_id: (r.width, r.height, bytes.fromhex(r.rgba)) for r in catalogue.queries()["tile_rgba"](spark, sf_dir).collect()}
    for r in catalogue.queries()["tile_png"](spark, sf_dir).collect():
        assert decoded(bytes(r.png)) == rgba[r.tile_id]


def decoded(png):
    """Width, height and pixels of an image of eight bits a channel without filters, read chunk by chunk."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        assert int.from_bytes(png[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + data)
        chunks[kind] = chunks.get(kind, b"") + data
        at += 12 + n
    width, height = int.from_bytes(chunks[b"IHDR"][:4], "big"), int.from_bytes(chunks[b"IHDR"][4:8], "big")
    assert chunks[b"IHDR"][8:] == bytes([8, 6, 0, 0, 0])
    raw = zlib.decompress(chunks[b"IDAT"])
    lines = [raw[k * (4 * width + 1) : (k + 1) * (4 * width + 1)] for k in range(height)]
    assert len(raw) == height * (4 * width + 1) and {x[0] for x in lines} == {0}
    return width, height, b"".join(x[1:] for x in lines)


def test_every_name_has_a_query():
    assert set(SQL) <= set(catalogue.queries())
