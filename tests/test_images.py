import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import images as I
from lodestat.operators import detect


def picture(h=40, w=56, seed=0):
    y, x = np.mgrid[:h, :w]
    base = np.stack([x * 255 / max(w - 1, 1), y * 255 / max(h - 1, 1), (x + y) * 255 / max(h + w - 2, 1)], axis=2)
    return np.clip(base + np.random.default_rng(seed).normal(0, 20, (h, w, 3)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (1, 9), (7, 3), (40, 56)])
def test_every_view_takes_any_size(size):
    image = picture(*size)
    before = image.copy()
    for view in I.eval_grid() + I.eval_grid_combinations():
        out = view.apply(image)
        assert out.dtype == np.uint8 and out.ndim == 3 and min(out.shape[:2]) >= 1
        assert (image == before).all()
    assert len({v.name for v in I.eval_grid()}) == 16
    assert I.native_crop(image, 16).shape == (16, 16, 3)


def test_degradations_are_monotone_and_seeded():
    image = picture()
    loss = lambda out: float(((out.astype(float) - image) ** 2).mean())
    jpeg = [loss(I.jpeg(image, q)) for q in (90, 70, 50, 30)]
    blur = [loss(I.gaussian_blur(image, s)) for s in (0.5, 1.0, 2.0)]
    assert jpeg == sorted(jpeg) and blur == sorted(blur)
    a, b = (I.eval_grid(3)[11].apply(image) for _ in range(2))
    assert (a == b).all() and (I.train_augment(image, 5) == I.train_augment(image, 5)).all()


def test_png_round_trip_and_bad_files():
    image = picture(5, 7)
    back, error = I.load(I.encode_png(image))
    assert error is None and (back == image).all()
    assert I.header(I.encode_png(image)) == ("PNG", 7, 5)
    for raw in (None, b"", b"junk", I.encode_png(image)[:40]):
        out, error = I.load(raw)
        assert out is None and error


def test_crops():
    image = picture(10, 4)
    padded, share = I.reflect_pad_to(image, 12)
    assert padded.shape == (12, 12, 3) and abs(share - (1 - 40 / 144)) < 1e-9 and (padded[:10, :4] == image).all()
    assert len(I.multi_crop_views(image, 8)) == 5
    with pytest.raises(ValueError):
        I.native_crop(image, 0)
    assert I.srm_filters().shape == (3, 5, 5) and abs(I.srm_filters().sum()) < 1e-9
    s = I.fft_spectrum(image)
    assert s.min() == 0 and s.max() == 1


def test_detector_contract(spark):
    rows = spark.createDataFrame([("b", I.encode_png(picture())), ("a", b""), ("c", None)], "image_path string, content binary")
    probe = detect.build_detector("probe", encoder=lambda x: x.reshape(-1, 3).mean(axis=0), weights=[0.1, 0.0, -0.1], bias=0.0)
    got = {r["image_path"]: r for r in probe.predict(rows).collect()}
    assert 0 < got["b"]["pred"] < 1 and got["b"]["error"] is None and got["a"]["pred"] is None and got["a"]["error"] == "empty file"
    assert {r["pred"] for r in detect.build_detector("constant", score=0.3).predict(rows).collect()} == {0.3}
    with pytest.raises(ValueError):
        detect.build_detector("constant", score=2)
    with pytest.raises(ValueError):
        detect.build_detector("other")
    assert detect.degrade(rows, crop=16).count() == 16


def test_predictions_of_files(spark):
    files = detect.drawn(spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>"), broken=F.col("vec_id") == 2)
    rows = detect.predict_files(files, detect.build_detector("mean"), include_failures=True).collect()
    assert [(r["image_path"], r["pred"] is None, r["error"] is None) for r in rows] == [("/images/1.png", False, True), ("/images/2.png", True, False)]
    assert detect.predict_files(files, detect.build_detector("mean")).count() == 1
    dark = detect.predict_files(files, detect.build_detector("mean"), degrade_by=lambda x: x // 2).first()["pred"]
    assert dark < rows[0]["pred"]


def test_view_builders():
    image = picture()
    views = I.train_views(image, 4, 16, seed=3)
    assert len(views) == 4 and all(v.shape == (16, 16, 3) for v in views) and (views[0] == I.native_crop(image, 16)).all()
    assert (I.train_views(image, 4, 16, seed=3)[2] == views[2]).all()
    assert set(I.eval_views(image, 16, I.eval_grid())) == {v.name for v in I.eval_grid()}


def test_png_filters():
    """All five line filters, written by hand."""
    image = picture(5, 6).astype(int)
    lines, above = [], np.zeros((6, 3), int)
    for mode, row in enumerate(image):
        left, corner = np.vstack([np.zeros((1, 3), int), row[:-1]]), np.vstack([np.zeros((1, 3), int), above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][mode]
        lines.append(bytes([mode]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    back, error = I.load(raw)
    assert error is None and (back == image).all()


def as_jpeg(image, halved=(1, 1), restart=0, extra=b"", grey=False):
    """A baseline JPEG with plain codes: symbol k of each table is k + 1 in 8 bits."""
    dc, ac = list(range(12)), [0, *(r << 4 | s for r in range(16) for s in range(1, 11)), 0xF0]
    x = image.astype(float)
    y = x @ I.LUMA
    planes = [y] if grey else [y, (x[..., 2] - y) / 1.772 + 128, (x[..., 0] - y) / 1.402 + 128]
    (a, b), (h, w) = halved, y.shape
    rows, columns = -(-h // (8 * a)), -(-w // (8 * b))
    blocks = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, rows * 8 * a - h), (0, columns * 8 * b - w)), mode="edge")
        if k:
            p = p.reshape(rows * 8, a, columns * 8, b).mean(axis=(1, 3))
        c = (p - 128).reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        blocks.append(np.rint(I.DCT @ c @ I.DCT.T).astype(int).reshape(*c.shape[:2], 64)[..., I.ZIGZAG])
    bits, out, last = [], b"", [0] * 3

    def put(value, n):
        bits.append(format(value, f"0{n}b") if n else "")

    def number(v, table, run=0):
        n = abs(v).bit_length()
        put(table.index(run << 4 | n) + 1, 8)
        put(v if v >= 0 else v + (1 << n) - 1, n)

    def flush():
        text = "".join(bits)
        bits.clear()
        text += "1" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")

    for m in range(rows * columns):
        if restart and m and m % restart == 0:
            out += flush() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            last = [0] * 3
        r, c = divmod(m, columns)
        for k in range(len(planes)):
            u, v = (a, b) if k == 0 else (1, 1)
            for block in (blocks[k][r * u + i, c * v + j] for i in range(u) for j in range(v)):
                number(int(block[0]) - last[k], dc)
                last[k], run = int(block[0]), 0
                for z in block[1:].tolist():
                    if not z:
                        run += 1
                        continue
                    while run > 15:
                        put(ac.index(0xF0) + 1, 8)
                        run -= 16
                    number(z, ac, run)
                    run = 0
                if run:
                    put(ac.index(0) + 1, 8)
    out += flush()
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    codes = lambda t, s: bytes([t]) + bytes([0] * 7 + [len(s) + 1] + [0] * 8) + bytes([0, *s])  # noqa: E731  code 0 is not used
    n = len(planes)
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, (b << 4 | a) if k == 0 else 0x11, 0]) for k in range(n))
    scan = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0])
    interval = part(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + extra + part(0xDB, bytes([0]) + bytes([1] * 64)) + part(0xC0, frame) + part(0xC4, codes(0, dc)) + part(0xC4, codes(16, ac)) + interval + part(0xDA, scan) + out + b"\xff\xd9"


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (17, 30)])
def test_jpeg_files_are_read(size):
    y, x = np.mgrid[: size[0], : size[1]]
    image = np.stack([x * 7 % 256, y * 11 % 256, (x + y) * 5 % 256], axis=2).astype(np.uint8)
    for settings in ({}, {"restart": 2}):
        back, error = I.load(as_jpeg(image, **settings))
        assert error is None and back.shape == image.shape and np.abs(back.astype(int) - image).max() <= 3
    half, _ = I.load(as_jpeg(image, (2, 2)))
    assert half.shape == image.shape and np.abs((half.astype(float) - image) @ I.LUMA).mean() < 12
    grey, _ = I.load(as_jpeg(image, grey=True))
    assert (grey[..., 0] == grey[..., 2]).all() and np.abs(grey[..., 0] - image @ I.LUMA).max() <= 2
    assert I.header(as_jpeg(image)) == ("JPEG", size[1], size[0])


def test_jpeg_orientation_and_bad_files():
    image = picture(9, 20)
    exif = lambda k: b"Exif\0\0MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x112, 3, 1, k, 0)
    plain, _ = I.load(as_jpeg(image))
    for k, turned in ((1, plain), (2, plain[:, ::-1]), (3, plain[::-1, ::-1]), (4, plain[::-1]), (5, plain.swapaxes(0, 1)), (6, np.rot90(plain, -1)), (8, np.rot90(plain))):
        body = exif(k)
        got, error = I.load(as_jpeg(image, extra=b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body))
        assert error is None and got.shape == turned.shape and (got == turned).all(), k
    assert I.load(b"\xff\xd8\xff\xd9")[1] and I.load(as_jpeg(image)[:60])[1] and I.load(as_jpeg(image).replace(b"\xff\xc0", b"\xff\xc2"))[1]
