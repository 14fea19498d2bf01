"""Measurements on photos: numpy kernels inside tasks, a photo at a time; no pixel is ever shuffled.

Photos come as `image_id, width, height, data` with `data` being RGB or BGR bytes, rows
from the top.  Broken rows (null or short data) give null measurements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weft.functions.color import PALETTE, _lab_of

METRICS = ["short_edge", "aspect_ratio", "brightness_mean", "brightness_std", "laplacian_variance", "entropy", "foreground_ratio", "mean_saturation"]
#: Distances from the background, area limits, and confidence of the foreground proposal.
FOREGROUND_DISTANCE, PROPOSAL_DISTANCE, PROPOSAL_MIN, PROPOSAL_MAX, PROPOSAL_CONFIDENCE = 28.0, 30.0, 0.08, 0.97, 0.30
#: Pixels that are clustered, clusters, and the shares below which they are dropped or not named.
SAMPLE, CLUSTERS, TINY_SHARE, MIN_SHARE, SAME_DISTANCE, MULTICOLOR_FROM = 40_000, 5, 0.01, 0.08, 30.0, 3


def to_pixels(data: bytes | None, width: int, height: int, bgr: bool = False) -> np.ndarray | None:
    if data is None or len(data) < width * height * 3 or width < 1 or height < 1:
        return None
    image = np.frombuffer(data, np.uint8, width * height * 3).reshape(height, width, 3)
    return image[:, :, ::-1] if bgr else image


def gray_of(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    if min(gray.shape) < 2:
        return 0.0
    p = np.pad(gray.astype(float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def border_median(image: np.ndarray, band: int) -> np.ndarray:
    edges = [image[:band], image[-band:], image[:, :band], image[:, -band:]]
    return np.median(np.concatenate([e.reshape(-1, 3) for e in edges]).astype(np.float32), axis=0)


def background_distance(image: np.ndarray, band: int) -> np.ndarray:
    return np.linalg.norm(image.astype(np.float32) - border_median(image, band), axis=2)


def photo_metrics(image: np.ndarray) -> dict[str, float]:
    height, width = image.shape[:2]
    gray = gray_of(image)
    share = np.bincount(gray.ravel(), minlength=256) / gray.size
    share = share[share > 0]
    far = 1.0 if min(height, width) < 8 else float((background_distance(image, max(1, min(height, width) // 20)) > FOREGROUND_DISTANCE).mean())
    top = image.max(axis=2).astype(float)
    saturation = np.where(top > 0, np.rint(255 * (top - image.min(axis=2)) / np.where(top > 0, top, 1)), 0)
    return {
        "short_edge": float(min(height, width)), "aspect_ratio": round(width / height, 4), "brightness_mean": round(float(gray.mean()), 3), "brightness_std": round(float(gray.std()), 3),
        "laplacian_variance": round(laplacian_variance(gray), 3), "entropy": round(float(-(share * np.log2(share)).sum()), 4), "foreground_ratio": round(far, 4), "mean_saturation": round(float(saturation.mean() / 255), 4),
    }


def measure_photos(photos: DataFrame, bgr: bool = False) -> DataFrame:
    """image_id, width, height and METRICS; the bytes end here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                image = to_pixels(r.data, r.width, r.height, bgr)
                rows.append({"image_id": r.image_id, "width": r.width, "height": r.height} | (photo_metrics(image) if image is not None else dict.fromkeys(METRICS)))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", *METRICS])

    kind = photos.schema["image_id"].dataType.simpleString()
    return photos.select("image_id", "width", "height", "data").mapInPandas(run, f"image_id {kind}, width int, height int, " + ", ".join(f"{m} double" for m in METRICS))


def _shifted(mask: np.ndarray, offsets: list[tuple[int, int]], grow: bool) -> np.ndarray:
    r = max(max(abs(a), abs(b)) for a, b in offsets)
    p = np.pad(mask, r, constant_values=not grow)
    views = [p[r + a : r + a + mask.shape[0], r + b : r + b + mask.shape[1]] for a, b in offsets]
    return np.logical_or.reduce(views) if grow else np.logical_and.reduce(views)


def morph(mask: np.ndarray, size: int, first_grow: bool, times: int = 1) -> np.ndarray:
    """Closing (first_grow) or opening of a mask with a disc of `size` pixels across."""
    r = size // 2
    disc = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r + 1]
    for grow in [first_grow] * times + [not first_grow] * times:
        mask = _shifted(mask, disc, grow)
    return mask


def largest_component(mask: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """Area, left, top, right, bottom (exclusive) of the largest 8-connected part: runs of each line are joined with those above."""
    starts = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begin = np.nonzero(starts == 1)
    end = np.nonzero(starts == -1)[1]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    line = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = line[y - 1], line[y]
        while i < line[y] and j < line[y + 1]:
            if begin[i] <= end[j] and begin[j] <= end[i]:
                parent[root(j)] = root(i)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    if not len(rows):
        return None
    roots = np.array([root(i) for i in range(len(rows))])
    area = np.bincount(roots, weights=end - begin)
    own = roots == int(area.argmax())
    return int(area.max()), int(begin[own].min()), int(rows[own].min()), int(end[own].max()), int(rows[own].max()) + 1


def propose_box(image: np.ndarray) -> dict | None:
    """The box of what differs from the border, or None."""
    height, width = image.shape[:2]
    if min(height, width) < 8:
        return None
    mask = background_distance(image, max(1, min(height, width) // 20)) > PROPOSAL_DISTANCE
    found = largest_component(morph(morph(mask, 9, True, 2), 9, False))
    if found is None or found[0] / mask.size < PROPOSAL_MIN or (found[3] - found[1]) * (found[4] - found[2]) / mask.size > PROPOSAL_MAX:
        return None
    return {"x1": float(found[1]), "y1": float(found[2]), "x2": float(found[3]), "y2": float(found[4]), "score": PROPOSAL_CONFIDENCE}


def lab_of(pixels: np.ndarray) -> np.ndarray:
    """8-bit coded LAB of RGB rows, a and b around zero."""
    v = pixels.astype(float) / 255
    v = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = v @ m.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[:, 1] > 0.008856, 116 * f[:, 1] - 16, 903.3 * xyz[:, 1])
    return np.stack([np.rint(light * 2.55), np.rint(500 * (f[:, 0] - f[:, 1])), np.rint(200 * (f[:, 1] - f[:, 2]))], axis=1)


_ANCHORS = np.array([_lab_of(h) for _, h, _, _ in PALETTE])
_BANDS = np.array([b for *_, b in PALETTE])


def name_of(lab: np.ndarray) -> int:
    band = "light" if lab[0] > 78.0 else "dark" if lab[0] < 38.0 else "any"
    distance = np.linalg.norm(_ANCHORS - lab, axis=1)
    return int(np.where((_BANDS == "any") | (_BANDS == band), distance, np.inf).argmin())


def cluster_colors(points: np.ndarray, weights: np.ndarray, k: int, seed: int = 7, restarts: int = 4, steps: int = 40) -> np.ndarray:
    """Weighted k-means labels (seeded, spread starts)."""
    best, k = None, min(k, len(points))
    for restart in range(restarts):
        rng = np.random.default_rng(seed + restart)
        centres = points[[rng.choice(len(points), p=weights / weights.sum())]]
        while len(centres) < k:
            d = ((points[:, None] - centres[None]) ** 2).sum(2).min(1) * weights
            centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else 0]])
        for _ in range(steps):
            d = ((points[:, None] - centres[None]) ** 2).sum(2)
            own = d.argmin(1)
            new = np.array([np.average(points[own == j], axis=0, weights=weights[own == j]) if (own == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = float((d.min(1) * weights).sum())
        if best is None or cost < best[0] - 1e-9:
            best = (cost, own)
    return best[1]


def dominant_colors(pixels: np.ndarray, max_secondary: int = 2) -> dict:
    """primary, hex, secondary, distribution, is_multicolor, pixel_count of a garment's pixels (rows of RGB)."""
    if not len(pixels):
        return {"primary": "unknown", "primary_hex": "#000000", "secondary": [], "distribution": {}, "is_multicolor": False, "pixel_count": 0}
    sample = pixels[:: max(1, -(-len(pixels) // SAMPLE))]
    colors, counts = np.unique(sample // 4 * 4 + 2, axis=0, return_counts=True)
    own = cluster_colors(lab_of(colors), counts.astype(float), CLUSTERS)
    swatches: list[list] = []
    for j in np.unique(own):
        share = counts[own == j].sum() / counts.sum()
        if share >= TINY_SHARE:
            mean = np.average(colors[own == j], axis=0, weights=counts[own == j])
            swatches.append([name_of(lab_of(mean[None])[0]), float(share)])
    swatches.sort(key=lambda s: -s[1])
    merged: list[list] = []
    for name, share in swatches:
        for m in merged:
            if m[0] == name or (PALETTE[m[0]][2] == PALETTE[name][2] and np.linalg.norm(_ANCHORS[m[0]] - _ANCHORS[name]) <= SAME_DISTANCE):
                m[1] += share
                break
        else:
            merged.append([name, share])
    total = sum(s for _, s in merged)
    merged = sorted(([n, s / total] for n, s in merged), key=lambda s: -s[1])
    named = [m for m in merged if m[1] >= MIN_SHARE] or merged[:1]
    spread = {PALETTE[n][0]: round(s, 4) for n, s in named}
    if sum(s for _, s in named) < 1 - 1e-6:
        spread["other"] = round(1 - sum(s for _, s in named), 4)
    return {"primary": PALETTE[named[0][0]][0], "primary_hex": PALETTE[named[0][0]][1], "secondary": [PALETTE[n][0] for n, _ in named[1 : 1 + max_secondary]], "distribution": spread, "is_multicolor": len(named) >= MULTICOLOR_FROM, "pixel_count": len(pixels)}


def garment_colors(photos: DataFrame, bgr: bool = False) -> DataFrame:
    """image_id and dominant_colors() of photos with an optional `mask` (bytes, above 0 inside); with a mask of another size the colour is unknown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples(index=False):
                image = to_pixels(r.data, r.width, r.height, bgr)
                pixels = np.empty((0, 3), np.uint8) if image is None else image.reshape(-1, 3)
                if image is not None and r.mask is not None and len(r.mask) != r.height * r.width:
                    pixels = pixels[:0]  # a mask of another size says nothing; the row has no colour, the job goes on
                elif image is not None and r.mask is not None:
                    inside = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) > 0
                    tight = morph(inside, 3, False) if inside.any() else inside
                    pixels = image[tight if tight.any() else inside]
                rows.append({"image_id": r.image_id} | dominant_colors(pixels))
            yield pd.DataFrame(rows)

    kind = photos.schema["image_id"].dataType.simpleString()
    out = f"image_id {kind}, primary string, primary_hex string, secondary array<string>, distribution map<string,double>, is_multicolor boolean, pixel_count int"
    return photos.select("image_id", "width", "height", "data", "mask").mapInPandas(run, out)


def mask_statistics(mask: np.ndarray, box: tuple[float, float, float, float]) -> dict[str, float]:
    """coverage of the box and solidity of the frame by a mask."""
    inside = int((mask > 0).sum())
    area = max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1])
    return {"coverage": inside / max(1.0, area), "solidity": inside / max(1, mask.size)}


def brighten(image: np.ndarray, gamma: float) -> np.ndarray:
    return (np.linspace(0, 1, 256) ** gamma * 255).astype(np.uint8)[image]
