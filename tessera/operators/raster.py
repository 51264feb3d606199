"""Drawing on BGR images (NumPy arrays of shape rows x cols x 3, uint8) and portable pixmaps of them."""

from __future__ import annotations

import numpy as np

Colour = tuple[int, int, int]


def make_bgr_image(rows: int, cols: int, colour: Colour = (0, 0, 0)) -> np.ndarray:
    return fill_bgr(np.zeros((rows, cols, 3), np.uint8), colour)


def fill_bgr(image: np.ndarray, colour: Colour) -> np.ndarray:
    image[:] = colour
    return image


def _stamp(image: np.ndarray, rows: np.ndarray, cols: np.ndarray, colour: Colour, thickness: int) -> np.ndarray:
    r = max(thickness, 1) // 2
    for a in range(-r, r + 1):
        for b in range(-r, r + 1):
            y, x = rows + a, cols + b
            ok = (y >= 0) & (y < image.shape[0]) & (x >= 0) & (x < image.shape[1])
            image[y[ok], x[ok]] = colour
    return image


def draw_line(image: np.ndarray, start: tuple[int, int], end: tuple[int, int], colour: Colour, thickness: int = 1) -> np.ndarray:
    """From (row, col) to (row, col), both included; parts outside are left out."""
    n = max(abs(end[0] - start[0]), abs(end[1] - start[1]), 1) + 1
    rows = np.floor(np.linspace(start[0], end[0], n) + 0.5).astype(int)
    cols = np.floor(np.linspace(start[1], end[1], n) + 0.5).astype(int)
    return _stamp(image, rows, cols, colour, thickness)


def draw_polyline(image: np.ndarray, points: list[tuple[int, int]], colour: Colour, closed: bool = False, thickness: int = 1) -> np.ndarray:
    ends = points[1:] + ([points[0]] if closed else [])
    for a, b in zip(points, ends, strict=False):
        draw_line(image, a, b, colour, thickness)
    return image


def draw_circle(image: np.ndarray, centre: tuple[int, int], radius: int, colour: Colour, filled: bool = False) -> np.ndarray:
    y, x = np.mgrid[0 : image.shape[0], 0 : image.shape[1]]
    d = np.hypot(y - centre[0], x - centre[1])
    image[d <= radius if filled else np.abs(d - radius) < 0.5 + 1e-9] = colour
    return image


def write_bgr_image(path: str, image: np.ndarray) -> None:
    """A portable pixmap."""
    with open(path, "wb") as f:
        f.write(f"P6 {image.shape[1]} {image.shape[0]} 255\n".encode() + np.ascontiguousarray(image[..., ::-1]).tobytes())
