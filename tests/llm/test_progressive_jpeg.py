from __future__ import annotations

import numpy as np
import pytest

from windrose.llm import progressive_jpeg as J


def picture(h, w, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    planes = [127 + 100 * np.sin(x / 9 + k) * np.cos(y / 7 - k) + rng.normal(0, 6, (h, w)) for k in range(3)]
    return np.clip(np.stack(planes, axis=2), 0, 255).astype(np.uint8)


def direct(pixels: np.ndarray) -> np.ndarray:
    """The picture after quantisation only: no scans, no entropy coding."""
    h, w = pixels.shape[:2]
    planes = []
    for k, (blocks, stride, _, _) in enumerate(J.coefficients(pixels)):
        spectrum = np.zeros((len(blocks), 64))
        spectrum[:, J.ZIGZAG] = np.array(blocks) * (J.CHROMA if k else J.LUMA)
        parts = (J._DCT.T @ spectrum.reshape(-1, 8, 8) @ J._DCT).reshape(-1, stride, 8, 8).transpose(0, 2, 1, 3)
        plane = np.clip(np.rint(parts.reshape(parts.shape[0] * 8, stride * 8) + 128), 0, 255)
        planes.append((plane if not k else plane.repeat(2, 0).repeat(2, 1))[:h, :w])
    y, cb, cr = planes
    rgb = [y + 1.402 * (cr - 128), y - 0.344136286 * (cb - 128) - 0.714136286 * (cr - 128), y + 1.772 * (cb - 128)]
    return np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255)


@pytest.mark.parametrize(("h", "w", "restart"), [(1, 1, 0), (16, 16, 0), (17, 33, 0), (48, 40, 2), (8, 100, 1), (31, 15, 0)])
def test_scans_restore_the_quantised_coefficients_exactly(h, w, restart):
    pixels = picture(h, w)
    got = J.decode(J.encode(pixels, restart))
    assert got.shape == (h, w, 3) and got.dtype == np.uint8
    assert np.abs(got.astype(float) - direct(pixels)).max() <= 1


def test_extreme_pictures():
    rng = np.random.default_rng(3)
    for pixels in (np.zeros((20, 20, 3), np.uint8), np.full((20, 20, 3), 255, np.uint8), rng.integers(0, 256, (40, 56, 3)).astype(np.uint8)):
        assert np.abs(J.decode(J.encode(pixels)).astype(float) - direct(pixels)).max() <= 1


def test_query_and_broken_files(spark):
    good = J.encode(picture(20, 24))
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"not a picture"), (5, good[: len(good) // 3]), (None, good), (6, good[:2]), (7, good.replace(b"\xff\xc2", b"\xff\xc9"))]
    df = spark.createDataFrame(rows, "vec_id bigint, file binary").selectExpr("*", "'x' as rgb", "'y' as error", "1 as width", "'z' as extra")
    out = J.decoded(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["vec_id"] in (1, None):
            assert (r["width"], r["height"], len(r["rgb"]), r["error"]) == (24, 20, 24 * 20 * 3, None) and bytes(r["rgb"]) == J.decode(good).tobytes()
        else:
            assert r["rgb"] is None and r["error"]
    assert {r["error"] for r in out if r["vec_id"] in (2, 3)} == {"no data"}
    assert J.decoded(spark.createDataFrame([], "file binary")).count() == 0


def test_thumbnails_equal_brute_force(spark):
    vectors = [(i, [float((i * k) % 7) for k in range(64)]) for i in range(5)] + [(9, None), (10, []), (11, [None, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    for r in J.decoded(J.thumbnails(df)).collect():
        v = dict(vectors)[r["vec_id"]]
        if v is None:
            assert r["rgb"] is None
        else:
            want = direct(J.thumbnail([x if x is not None else 0.0 for x in v], r["vec_id"]))
            assert np.abs(np.frombuffer(r["rgb"], np.uint8).reshape(want.shape).astype(float) - want).max() <= 1


def test_header_bombs_are_errors_without_memory():
    import tracemalloc

    good = J.encode(picture(16, 16))
    at = good.index(b"\xff\xc2") + 5
    tracemalloc.start()
    for side, why in ((4096, "truncated scan"), (26_000, "truncated scan"), (65_500, "2 GiB")):
        bomb = good[:at] + side.to_bytes(2, "big") * 2 + good[at + 4 :]
        with pytest.raises(J.BadImage, match=why):
            J.decode(bomb)
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()


def test_tensors_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(J, "_TOGETHER", 3000)
    df = spark.createDataFrame([(i, J.encode(picture(20, 10 + i))) for i in range(7)] + [(9, None)], "n bigint, file binary").coalesce(1)
    assert {(r["n"], r["width"]) for r in J.decoded(df).collect()} == {(i, 10 + i) for i in range(7)} | {(9, None)}
