"""Image kernels in numpy: reading, degrading, cropping, forensic filters.

An image is uint8 (height, width, 3). Every kernel takes any size from 1 x 1 on,
leaves its input alone and gives a new image. They run inside Arrow-batched
Python operators only (see :mod:`lodestat.operators.detect`).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Fixed values of the JPEG standard (annex K): quantisation at quality 50.
LUMA_Q = np.array(
    [[16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
     [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99]]
)
CHROMA_Q = np.array(
    [[17, 18, 24, 47, 99, 99, 99, 99], [18, 21, 26, 66, 99, 99, 99, 99], [24, 26, 56, 99, 99, 99, 99, 99], [47, 66, 99, 99, 99, 99, 99, 99],
     [99] * 8, [99] * 8, [99] * 8, [99] * 8]
)
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))
LUMA = np.array([0.299, 0.587, 0.114])

# ---- reading


def header(raw: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the first bytes of a file, or None."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return ("PNG", *struct.unpack(">II", raw[16:24]))
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return "BMP", w, abs(h)
    if raw[:3] == b"GIF" and len(raw) >= 10:
        return ("GIF", *struct.unpack("<HH", raw[6:10]))
    if raw[:4] == b"RIFF" and raw[8:15] == b"WEBPVP8" and len(raw) >= 30:
        if raw[15:16] == b"X":
            return "WEBP", 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
        if raw[15:16] == b" ":
            w, h = struct.unpack("<HH", raw[26:30])
            return "WEBP", w & 0x3FFF, h & 0x3FFF
        bits = int.from_bytes(raw[21:25], "little")
        return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw):
            if raw[at] != 0xFF:
                return None
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    return None


def on_white(pixels: np.ndarray) -> np.ndarray:
    """RGB of RGBA pixels over white."""
    a = pixels[..., 3:].astype(float) / 255
    return np.rint(pixels[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def _png(raw: bytes) -> np.ndarray:
    at, data, palette, clear = 8, b"", None, None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlace is read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.int64)
    above = np.zeros(w * n, np.int64)
    for y in range(h):
        mode, row = lines[y, 0], lines[y, 1:].astype(np.int64)
        if mode == 2:
            row = (row + above) & 255
        elif mode == 1:
            row = np.cumsum(row.reshape(w, n), axis=0).reshape(-1) & 255
        elif mode:
            for x in range(w * n):
                left = row[x - n] if x >= n else 0
                up, corner = above[x], above[x - n] if x >= n else 0
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))
                    guess = near[2]
                row[x] = (row[x] + guess) & 255
        out[y] = above = row
    pixels = out.astype(np.uint8).reshape(h, w, n)
    if color == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        return on_white(np.concatenate([palette, alpha[:, None]], axis=1)[pixels[..., 0]])
    if n in (1, 2):
        pixels = np.concatenate([pixels[..., :1]] * 3 + [pixels[..., 1:]], axis=2)
    return on_white(pixels) if pixels.shape[2] == 4 else pixels


# Order of a JPEG block's coefficients: along anti-diagonals, every second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8))))


class _Bits:
    """Bits of one stretch of entropy-coded data; beyond its end, zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.held = data, 0, 0, 0

    def peek16(self) -> int:
        while self.held < 16:
            self.word = (self.word << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.at, self.held = self.at + 1, self.held + 8
        return self.word >> (self.held - 16) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek16() >> (16 - n)
        self.held -= n
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        n, value = table[self.peek16()]
        if not n:
            raise ValueError("a JPEG code that its table lacks")
        self.held -= n
        return value

    def number(self, n: int) -> int:
        """A signed number of n bits."""
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _codes(body: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of the code that each 16 bits start with."""
    counts, symbols = body[:16], body[16:]
    table, code, k = [(0, 0)] * 65536, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            table[code << (16 - n) : (code + 1) << (16 - n)] = [(n, symbols[k])] * (1 << (16 - n))
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _orientation(exif: bytes) -> int:
    """The orientation that a camera has noted, 1 if none."""
    tiff = exif[6:]
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if exif[:4] != b"Exif" or order is None:
        return 1
    number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
    at = number(4, 4)
    for k in range(number(at, 2)):
        entry = at + 2 + 12 * k
        if number(entry, 2) == 0x112:
            return number(entry + 8, 2)
    return 1


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image as it was seen: 2 to 4 are mirrored or turned over, 5 to 8 also transposed."""
    k = orientation - 1 if 1 <= orientation <= 8 else 0
    if k >= 4:
        image, k = image.swapaxes(0, 1), k - 4
    down, across = k in (2, 3), k in (1, 2)
    return np.ascontiguousarray(image[:: -1 if down else 1, :: -1 if across else 1])


def _jpeg_file(raw: bytes) -> np.ndarray:
    """Baseline and extended sequential JPEG of 8 bits: grey, YCbCr, RGB, CMYK."""
    at, tables, quant, parts, order, restart, adobe, turn = 2, {}, {}, {}, [], 0, None, 1
    while at + 4 <= len(raw):
        if raw[at] != 0xFF or raw[at + 1] == 0xFF:
            at += 1
            continue
        kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if kind == 0xD9:
            break
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = _codes(body[1:n])
                body = body[n:]
        elif kind in (0xC0, 0xC1):
            h, w = struct.unpack(">HH", body[1:5])
            if body[0] != 8 or not h or not w:
                raise ValueError("only JPEG of 8 bits and stated size is read")
            spec = [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(body[5])]
            order = [i for i, _, _ in spec]
            tall, broad = max(s & 15 for _, s, _ in spec), max(s >> 4 for _, s, _ in spec)
            rows, columns = -(-h // (8 * tall)), -(-w // (8 * broad))
            parts = {i: [s & 15, s >> 4, q, np.zeros((rows * (s & 15), columns * (s >> 4), 64))] for i, s, q in spec}
        elif 0xC2 <= kind <= 0xCF and kind != 0xCC:
            raise ValueError("only sequential Huffman JPEG is read")
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xE1:
            turn = _orientation(body)
        elif kind == 0xDA:
            end = at
            while end + 1 < len(raw) and not (raw[end] == 0xFF and raw[end + 1] != 0 and not 0xD0 <= raw[end + 1] <= 0xD7):
                end += 1
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if len(chosen) == 1:
                i, t = chosen[0]
                a, b = parts[i][:2]
                units = [[(i, t, y, x)] for y in range(-(-(-(-h * a // tall)) // 8)) for x in range(-(-(-(-w * b // broad)) // 8))]
            else:
                blocks = [(i, t, y, x) for i, t in chosen for y in range(parts[i][0]) for x in range(parts[i][1])]
                units = [[(i, t, r * parts[i][0] + y, c * parts[i][1] + x) for i, t, y, x in blocks] for r in range(rows) for c in range(columns)]
            stretches = re.split(rb"\xff[\xd0-\xd7]", raw[at:end]) if restart else [raw[at:end]]
            step = restart or len(units)
            for k, data in enumerate(stretches):
                bits, last = _Bits(data.replace(b"\xff\0", b"\xff")), dict.fromkeys(parts, 0)
                for i, t, y, x in (b for unit in units[k * step : (k + 1) * step] for b in unit):
                    block = parts[i][3][y, x]
                    last[i] += bits.number(bits.symbol(tables[t >> 4]))
                    block[0] = last[i]
                    z, ac = 1, tables[16 + (t & 15)]
                    while z < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            z += 16
                            continue
                        z += s >> 4
                        if z > 63:
                            raise ValueError("a JPEG block of more than 64 numbers")
                        block[z] = bits.number(s & 15)
                        z += 1
            at = end
    if not parts:
        raise ValueError("a JPEG without an image")
    planes = []
    for i in order:
        a, b, q, blocks = parts[i]
        square = np.zeros(blocks.shape)
        square[..., ZIGZAG] = blocks * quant[q]
        plane = DCT.T @ square.reshape(*blocks.shape[:2], 8, 8) @ DCT + 128
        plane = _bytes(plane.swapaxes(1, 2).reshape(8 * blocks.shape[0], -1))
        planes.append(np.repeat(np.repeat(plane, tall // a, axis=0), broad // b, axis=1)[:h, :w].astype(float))
    if len(planes) == 1:
        rgb = np.stack(planes * 3, axis=2)
    else:
        rgb = np.stack(planes[:3], axis=2)
        if adobe != 0 and (len(planes) == 3 or adobe == 2):
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
        if len(planes) == 4:  # inks; Adobe's files hold them inverted
            ink = np.clip(rgb, 0, 255), planes[3][..., None]
            rgb = ink[0] * ink[1] / 255 if adobe is not None else (255 - ink[0]) * (255 - ink[1]) / 255
    return upright(_bytes(rgb), turn)


def encode_png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def load(raw: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(image, None), or (None, why not). Never raises."""
    if raw is None:
        return None, "not a file"
    if not len(raw):
        return None, "empty file"
    try:
        raw = bytes(raw)
        if raw[:4] == b"\x89PNG":
            return _png(raw), None
        if raw[:2] == b"\xff\xd8":
            return _jpeg_file(raw), None
        if raw[:2] == b"P6":
            w, h = (int(x) for x in raw.split(maxsplit=4)[1:3])
            return np.frombuffer(raw[-w * h * 3 :], np.uint8).reshape(h, w, 3).copy(), None
        return None, f"cannot decode {(header(raw) or ('unknown format',))[0]}"
    except Exception as e:  # noqa: BLE001  a bad file is a row with an error
        return None, f"{type(e).__name__}: {e}"


# ---- degradations


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane through 8 x 8 DCT and quantisation, and back."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    coefficients = np.rint(DCT @ blocks @ DCT.T / table) * table
    return (DCT.T @ coefficients @ DCT).swapaxes(1, 2).reshape(p.shape)[:h, :w] + 128


def jpeg(image: np.ndarray, quality: int) -> np.ndarray:
    """What a JPEG round trip (4:2:0) loses; its entropy coding loses nothing."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    luma, chroma = (np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (LUMA_Q, CHROMA_Q))
    x = image.astype(float)
    y = x @ LUMA
    h, w = y.shape
    planes = []
    for c in ((x[..., 2] - y) / 1.772, (x[..., 0] - y) / 1.402):
        p = np.pad(c, ((0, h % 2), (0, w % 2)), mode="edge")
        half = p.reshape(p.shape[0] // 2, 2, -1, 2).mean(axis=(1, 3))
        planes.append(np.repeat(np.repeat(_coded(half + 128, chroma) - 128, 2, axis=0), 2, axis=1)[:h, :w])
    y, (cb, cr) = _coded(y, luma), planes
    return _bytes(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2))


def _along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    p = np.pad(x, pad, mode="edge")
    return sum(k * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, k in enumerate(kernel))


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return _bytes(_along(_along(image.astype(float), k / k.sum(), 0), k / k.sum(), 1))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic (a = -0.5), widened when shrinking."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(n / m, 1.0)
        center = (np.arange(m) + 0.5) * n / m - 0.5
        d = np.abs((np.arange(n)[None, :] - center[:, None]) / scale)
        w = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
        return w / w.sum(axis=1, keepdims=True)

    h, w = image.shape[:2]
    return _bytes(np.einsum("yh,xw,hwc->yxc", weights(h, height), weights(w, width), image.astype(float), optimize=True))


def downscale_upscale(image: np.ndarray, scale: float) -> np.ndarray:
    h, w = image.shape[:2]
    return resize(resize(image, max(1, round(h * scale)), max(1, round(w * scale))), h, w)


def gaussian_noise(image: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return _bytes(image + 255 * rng.normal(0, sigma, image.shape))


def color_jitter(image: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """Brightness, then contrast about the mean grey, then saturation about each pixel's grey."""
    x = _bytes(image * brightness).astype(float)
    x = _bytes((x - np.rint((x @ LUMA).mean())) * contrast + np.rint((x @ LUMA).mean())).astype(float)
    grey = (x @ LUMA)[..., None]
    return _bytes(grey + (x - grey) * saturation)


def center_crop(image: np.ndarray, fraction: float) -> np.ndarray:
    h, w = image.shape[:2]
    ch, cw = max(1, round(h * fraction)), max(1, round(w * fraction))
    top, left = (h - ch) // 2, (w - cw) // 2
    return image[top : top + ch, left : left + cw].copy()


@dataclass(frozen=True)
class View:
    name: str
    family: str
    apply: Callable[[np.ndarray], np.ndarray]


# Strengths of the robustness grid's views, which their names carry, and
# the ranges that training draws from.
JPEG_QUALITY, BLUR_SIGMA, RESIZE_SCALE, NOISE_SIGMA = (90, 70, 50, 30), (0.5, 1.0, 2.0), (0.5, 0.25), (0.02, 0.05, 0.1)
COLOR_FACTOR, CROP_FRACTION = {"color_down": 0.8, "color_up": 1.2}, 0.8
TRAIN_RANGES = {"jpeg": (25, 96), "blur": (0.3, 2.2), "resize": (0.22, 0.85), "noise": (0.01, 0.11), "color": (0.75, 1.25), "crop": (0.75, 0.95)}
TRAIN_SEVERITY = (0.15, 0.35, 0.30, 0.20)


def eval_grid(noise_seed: int = 0) -> list[View]:
    """The 16 views of the robustness grid."""
    grid = [View("clean", "clean", lambda x: x.copy())]
    grid += [View(f"jpeg_q{q}", "jpeg", lambda x, q=q: jpeg(x, q)) for q in JPEG_QUALITY]
    grid += [View(f"blur_s{s}", "blur", lambda x, s=s: gaussian_blur(x, s)) for s in BLUR_SIGMA]
    grid += [View(f"resize_{s}x", "resize", lambda x, s=s: downscale_upscale(x, s)) for s in RESIZE_SCALE]
    grid += [View(f"noise_s{s}", "noise", lambda x, s=s, i=i: gaussian_noise(x, s, np.random.default_rng(noise_seed + i))) for i, s in enumerate(NOISE_SIGMA)]
    grid += [View(name, "color", lambda x, f=f: color_jitter(x, f, f, f)) for name, f in COLOR_FACTOR.items()]
    return [*grid, View(f"crop_{round(100 * CROP_FRACTION)}", "crop", lambda x: center_crop(x, CROP_FRACTION))]


def eval_grid_combinations(noise_seed: int = 0) -> list[View]:
    noise = lambda x: gaussian_noise(x, 0.02, np.random.default_rng(noise_seed))
    return [
        View("jpeg70+resize0.5", "combo", lambda x: downscale_upscale(jpeg(x, 70), 0.5)), View("crop80+jpeg50", "combo", lambda x: jpeg(center_crop(x, 0.8), 50)),
        View("resize0.5+blur1.0", "combo", lambda x: gaussian_blur(downscale_upscale(x, 0.5), 1.0)), View("jpeg50+noise0.02", "combo", lambda x: noise(jpeg(x, 50))),
    ]


def train_augment(image: np.ndarray, seed: int, severity: tuple[float, ...] = TRAIN_SEVERITY) -> np.ndarray:
    """k different degradations, k drawn by the severity weights, of drawn strength."""
    rng = np.random.default_rng(seed)
    kinds = {
        "jpeg": lambda x: jpeg(x, int(rng.integers(*TRAIN_RANGES["jpeg"]))), "blur": lambda x: gaussian_blur(x, rng.uniform(*TRAIN_RANGES["blur"])), "resize": lambda x: downscale_upscale(x, rng.uniform(*TRAIN_RANGES["resize"])),
        "noise": lambda x: gaussian_noise(x, rng.uniform(*TRAIN_RANGES["noise"]), rng), "color": lambda x: color_jitter(x, *rng.uniform(*TRAIN_RANGES["color"], 3)), "crop": lambda x: center_crop(x, rng.uniform(*TRAIN_RANGES["crop"])),
    }
    for name in rng.choice(list(kinds), size=int(rng.choice(len(severity), p=severity)), replace=False):
        image = kinds[name](image)
    return image.copy()


# ---- crops


def reflect_pad_to(image: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At least size x size, mirrored at the bottom and right; and the share that is padding."""
    h, w = image.shape[:2]
    need = (max(0, size - h), max(0, size - w))
    out = image
    for axis, n in enumerate(need):
        if n:
            pad = [(0, 0)] * 3
            pad[axis] = (0, n)
            out = np.pad(out, pad, mode="reflect" if out.shape[axis] > 1 else "edge")
    return out, 1 - h * w / (out.shape[0] * out.shape[1])


def native_crop(image: np.ndarray, size: int, mode: str = "center", rng: np.random.Generator | None = None) -> np.ndarray:
    """A size x size window at native resolution."""
    if size <= 0 or mode not in ("center", "random") or mode == "random" and rng is None:
        raise ValueError("size must be positive, and mode center, or random with a generator")
    padded, _ = reflect_pad_to(image, size)
    spare = (padded.shape[0] - size, padded.shape[1] - size)
    top, left = (s // 2 for s in spare) if mode == "center" else (int(rng.integers(0, s + 1)) for s in spare)
    return padded[top : top + size, left : left + size].copy()


def resized_view(image: np.ndarray, size: int) -> np.ndarray:
    return resize(image, size, size)


def multi_crop_views(image: np.ndarray, size: int, n_crops: int = 4, include_resized: bool = True, seed: int = 0) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    views = [native_crop(image, size)] + [native_crop(image, size, "random", rng) for _ in range(n_crops - 1)]
    return views + [resized_view(image, size)] * include_resized


def train_views(image: np.ndarray, n_views: int, crop_size: int, seed: int = 0) -> list[np.ndarray]:
    """A clean centre crop and n_views - 1 views degraded first, cropped at random then."""
    rng = np.random.default_rng(seed)
    views = [native_crop(image, crop_size)]
    return views + [native_crop(train_augment(image, seed + 1 + i), crop_size, "random", rng) for i in range(n_views - 1)]


def eval_views(image: np.ndarray, crop_size: int, views: list[View]) -> dict[str, np.ndarray]:
    """The centre crop of each degraded view, by name."""
    return {v.name: native_crop(v.apply(image), crop_size) for v in views}


# ---- forensic filters


# Three kernels of the steganalysis rich model.
SRM = (
    [[0, 0, 0, 0, 0], [0, -1, 2, -1, 0], [0, 2, -4, 2, 0], [0, -1, 2, -1, 0], [0, 0, 0, 0, 0]],
    [[-1, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]],
    [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 1, -2, 1, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]],
)
SRM_SCALE = (4, 12, 2)


def srm_filters() -> np.ndarray:
    """Three 5 x 5 high-pass kernels of the steganalysis rich model."""
    return np.array(SRM, float) / np.array(SRM_SCALE, float)[:, None, None]


def fft_spectrum(image: np.ndarray) -> np.ndarray:
    """Log magnitude of the centred spectrum of the grey image, scaled to [0, 1]."""
    s = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(image.astype(float) @ LUMA))))
    return (s - s.min()) / max(s.max() - s.min(), 1e-8)
