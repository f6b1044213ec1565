"""Painting regions on raw RGBA images, and PNG output without metadata."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that a painted box reaches over its edge; side of a pixelated cell; radius of a blur.
BLEED, CELL, RADIUS = 2, 12, 8
STYLES = ("solid", "gradient", "blur", "pixelate")
#: Letters of 3 by 5 dots, row by row; all that a token can hold.
GLYPHS = {
    "0": "### #.# #.# #.# ###", "1": ".#. ##. .#. .#. ###", "2": "##. ..# .#. #.. ###", "3": "##. ..# .#. ..# ##.", "4": "#.# #.# ### ..# ..#",
    "5": "### #.. ##. ..# ##.", "6": ".## #.. ### #.# ###", "7": "### ..# .#. .#. .#.", "8": "### #.# ### #.# ###", "9": "### #.# ### ..# ##.",
    "A": ".#. #.# ### #.# #.#", "B": "##. #.# ##. #.# ##.", "C": ".## #.. #.. #.. .##", "D": "##. #.# #.# #.# ##.", "E": "### #.. ##. #.. ###",
    "F": "### #.. ##. #.. #..", "G": ".## #.. #.# #.# .##", "H": "#.# #.# ### #.# #.#", "I": "### .#. .#. .#. ###", "J": "..# ..# ..# #.# .#.",
    "K": "#.# #.# ##. #.# #.#", "L": "#.. #.. #.. #.. ###", "M": "#.# ### ### #.# #.#", "N": "##. #.# #.# #.# #.#", "O": ".#. #.# #.# #.# .#.",
    "P": "##. #.# ##. #.. #..", "Q": ".#. #.# #.# ### .##", "R": "##. #.# ##. #.# #.#", "S": ".## #.. .#. ..# ##.", "T": "### .#. .#. .#. .#.",
    "U": "#.# #.# #.# #.# ###", "V": "#.# #.# #.# #.# .#.", "W": "#.# #.# ### ### #.#", "X": "#.# #.# .#. #.# #.#", "Y": "#.# #.# .#. .#. .#.",
    "Z": "### ..# .#. #.. ###", "_": "... ... ... ... ###", "[": "##. #.. #.. #.. ##.", "]": ".## ..# ..# ..# .##",
}


def stamp(box: np.ndarray, token: str) -> None:
    """Writes a token into the middle of a box, as large as fits, in black or white, whichever stands out; nothing where it
    doesn't fit. Characters without a glyph stay blank."""
    size = min((box.shape[1] - 2) // (4 * len(token)), (box.shape[0] - 2) // 5) if token else 0
    if size < 1:
        return
    dots = np.zeros((5, 4 * len(token)), bool)
    for i, c in enumerate(token):
        for y, row in enumerate(GLYPHS.get(c, "").split()):
            dots[y, 4 * i : 4 * i + 3] = [d == "#" for d in row]
    dots = dots.repeat(size, 0).repeat(size, 1)
    y, x = (box.shape[0] - dots.shape[0]) // 2, (box.shape[1] - dots.shape[1]) // 2
    box[y : y + dots.shape[0], x : x + dots.shape[1]][dots] = (0, 0, 0, 255) if box[..., :3].mean() > 127 else (255, 255, 255, 255)


def paint(width: int, height: int, rgba: bytes, regions: list[dict], style: str = "solid", color: tuple[int, int, int] = (0, 0, 0), stamped: bool = False) -> bytes:
    """The image with every enabled region covered. Colours are opaque; a region beyond the image is cut to it. stamped:
    regions' tokens are written on the boxes of solid and gradient, after all boxes are painted."""
    boxes = []
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).copy()
    for r in regions:
        if not r.get("enabled", True):
            continue
        x0, y0 = max(0, int(np.floor(r["x"])) - BLEED), max(0, int(np.floor(r["y"])) - BLEED)
        x1, y1 = min(width, int(np.ceil(r["x"] + r["w"])) + BLEED), min(height, int(np.ceil(r["y"] + r["h"])) + BLEED)
        if x0 >= x1 or y0 >= y1:
            continue
        box = image[y0:y1, x0:x1]
        if style == "pixelate":
            for y in range(0, box.shape[0], CELL):
                for x in range(0, box.shape[1], CELL):
                    cell = box[y : y + CELL, x : x + CELL]
                    cell[:] = cell.reshape(-1, 4).mean(0).astype(np.uint8)
        elif style == "blur":
            sums = np.pad(box.astype(np.int64), ((RADIUS + 1, RADIUS), (RADIUS + 1, RADIUS), (0, 0)), mode="edge").cumsum(0).cumsum(1)
            k = 2 * RADIUS + 1
            box[:] = ((sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]) // (k * k)).astype(np.uint8)
        elif style == "gradient":
            ramp = np.linspace(1, 0.5, box.shape[1])[None, :, None]
            box[..., :3] = (np.array(color) * ramp + 40 * (1 - ramp)).astype(np.uint8)
            box[..., 3] = 255
        else:
            box[:] = (*color, 255)
        boxes.append((box, r.get("token") or ""))
    for box, token in boxes if stamped and style in ("solid", "gradient") else ():
        stamp(box, token)
    return image.tobytes()


def reversible(style: Column) -> Column:
    return style.isin("blur", "pixelate")


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG file of three chunks: header, pixels, end."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def painted_png(width: Column, height: Column, rgba: Column, regions: Column, style: str = "solid", stamped: bool = False) -> Column:
    """PNG bytes of each painted image; null where the pixels don't fit the size."""
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}")

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ws, hs, pixels, rs in batches:
            yield pd.Series([png(w, h, paint(w, h, p, [dict(x) for x in r], style, stamped=stamped)) if p is not None and len(p) == 4 * w * h else None for w, h, p, r in zip(ws, hs, pixels, rs, strict=True)], dtype=object)

    return run(width, height, rgba, regions)


def thumbnail_size(width: Column, height: Column, most: int = 512) -> Column:
    """struct<width, height>: the longer side at most `most`, each at least 1; unchanged if it fits."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    fit = lambda side: F.when(scale < 1, F.greatest(F.lit(1), F.round(side * scale).cast("int"))).otherwise(side.cast("int"))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def shrink(width: int, height: int, rgba: bytes, most: int = 512) -> tuple[int, int, bytes]:
    """(width, height, pixels) with the longer side at most `most`: each new pixel is the mean of those it stands for."""
    scale = most / max(width, height)
    if scale >= 1:
        return width, height, rgba
    w, h = max(1, int(np.floor(width * scale + 0.5))), max(1, int(np.floor(height * scale + 0.5)))
    image = np.frombuffer(rgba, np.uint8).reshape(height, width, 4).astype(np.float64)
    ys, xs = np.arange(h) * height // h, np.arange(w) * width // w
    sums = np.add.reduceat(np.add.reduceat(image, ys, axis=0), xs, axis=1)
    cells = np.diff(np.append(ys, height))[:, None, None] * np.diff(np.append(xs, width))[None, :, None]
    return w, h, (sums / cells).astype(np.uint8).tobytes()
