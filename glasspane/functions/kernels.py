"""Kernels on one slide's raster, for footprints that column expressions cannot state."""

from __future__ import annotations

import numpy as np


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Component number of each pixel (0 outside the mask); numbers run in order of the first pixel met.

    Runs of each row are joined with the runs they touch in the row above.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    edge = np.diff(padded, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = np.searchsorted(row, np.arange(h + 1))
    reach = 1 if connectivity == 8 else 0
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = root(int(i)), root(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.fromiter(map(root, range(len(row))), np.int64, len(row))
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), np.int64)
    for r, a, b, k in zip(row, start, end, number):
        out[r, a:b] = k
    return out


def areas(labels: np.ndarray) -> np.ndarray:
    return np.bincount(labels.ravel())


def without_small(mask: np.ndarray, least: int, connectivity: int = 4) -> np.ndarray:
    """Components of fewer than ``least`` pixels go."""
    labels = label(mask, connectivity)
    return mask & (areas(labels) >= least)[labels]


def without_large(mask: np.ndarray, most: int, connectivity: int = 4) -> np.ndarray:
    labels = label(mask, connectivity)
    return mask & (areas(labels) <= most)[labels]


def filled(mask: np.ndarray, least: int, connectivity: int = 4) -> np.ndarray:
    """Background components of fewer than ``least`` pixels are filled."""
    return ~without_small(~mask, least, connectivity)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr * dr + dc * dc <= radius * radius]


def square(side: int) -> list[tuple[int, int]]:
    low = -(side // 2)
    return [(dr, dc) for dr in range(low, low + side) for dc in range(low, low + side)]


def shifted(a: np.ndarray, dr: int, dc: int, outside) -> np.ndarray:
    """a[r + dr, c + dc], and ``outside`` beyond the raster."""
    out = np.full_like(a, outside)
    h, w = a.shape
    r0, r1, c0, c1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
    if r0 < r1 and c0 < c1:
        out[r0:r1, c0:c1] = a[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def _folded(a: np.ndarray, footprint: list[tuple[int, int]], how: np.ufunc, outside) -> np.ndarray:
    """The fold of a raster's shifts over the footprint; one shift is held at a time."""
    out = shifted(a, *footprint[0], outside)
    for d in footprint[1:]:
        how(out, shifted(a, *d, outside), out=out)
    return out


def eroded(mask: np.ndarray, footprint: list[tuple[int, int]]) -> np.ndarray:
    """What lies beyond the raster counts as true."""
    return _folded(mask, footprint, np.logical_and, True)


def dilated(mask: np.ndarray, footprint: list[tuple[int, int]]) -> np.ndarray:
    """What lies beyond the raster counts as false."""
    return _folded(mask, footprint, np.logical_or, False)


def opened(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilated(eroded(mask, disk(radius)), disk(radius))


def lowest(a: np.ndarray, footprint: list[tuple[int, int]]) -> np.ndarray:
    """The least value under the footprint; what lies beyond the raster is ignored."""
    return _folded(a, footprint, np.minimum, a.max() if a.size else 0)


def lowest_disk(a: np.ndarray, radius: int) -> np.ndarray:
    """The same under a disk of any radius: of each of its rows, the least of two runs of a power of two.

    Runs come from one table of doublings, so a row of the disk costs two looks at a raster, however wide it is.
    """
    h, w = a.shape
    radius = min(radius, h + w)
    high = a.max() if a.size else 0
    if radius * radius >= (h - 1) ** 2 + (w - 1) ** 2:  # every disk holds the raster
        return np.full_like(a, a.min() if a.size else 0)
    runs = [np.pad(a, ((0, 0), (radius, radius)), constant_values=high)]
    while 2 << len(runs) - 1 <= 2 * radius + 1:
        last, step = runs[-1], 1 << len(runs) - 1
        runs.append(np.minimum(last[:, : last.shape[1] - step], last[:, step:]))
    out = np.full_like(a, high)
    for dr in range(-min(radius, h - 1), min(radius, h - 1) + 1):
        reach = int(np.sqrt(radius * radius - dr * dr))
        k = (2 * reach + 1).bit_length() - 1
        first, last = radius - reach, radius + reach + 1 - (1 << k)
        low = np.minimum(runs[k][:, first : first + w], runs[k][:, last : last + w])
        own = slice(max(0, -dr), min(h, h - dr))
        np.minimum(out[own], low[own.start + dr : own.stop + dr], out=out[own])
    return out


def median(a: np.ndarray, radius: int, rows: int = 64) -> np.ndarray:
    """Median under a disk; beyond the raster, values are ignored. Some rows at a time, each with all its shifts."""
    padded = np.pad(a.astype(float), radius, constant_values=np.nan)
    out = np.empty(a.shape)
    for top in range(0, a.shape[0], rows):
        h = min(rows, a.shape[0] - top)
        shifts = [padded[top + radius + dr : top + radius + dr + h, radius + dc : radius + dc + a.shape[1]] for dr, dc in disk(radius)]
        out[top : top + h] = np.nanmedian(np.stack(shifts), axis=0)
    return out


def gaussian_weights(sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur, cut at four sigma, with the edge values carried outward."""
    w = gaussian_weights(sigma)
    reach = len(w) // 2
    for axis in (0, 1):
        padded = np.pad(a, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = sum(w[k] * np.take(padded, range(k, k + a.shape[axis]), axis=axis) for k in range(len(w)))
    return a


def laplacian(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="symmetric")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a


def gabor(a: np.ndarray, frequency: float, theta: float, sigma: float) -> np.ndarray:
    """Real part of a Gabor filter's answer; the raster wraps around."""
    reach = int(np.ceil(max(1, 3 * sigma)))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    u = x * np.cos(theta) + y * np.sin(theta)
    kernel = np.exp(-(x * x + y * y) / (2 * sigma * sigma)) / (2 * np.pi * sigma * sigma) * np.cos(2 * np.pi * frequency * u)
    return sum(kernel[i, j] * np.roll(a, (y[i, j], x[i, j]), (0, 1)) for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


def ridges(a: np.ndarray, scales=(1, 3, 5, 7, 9), beta: float = 0.5, gamma: float = 15.0) -> np.ndarray:
    """Vesselness of dark ridges from the Hessian's eigenvalues, the greatest over the scales."""
    best = np.zeros(a.shape)
    for s in scales:
        g = gaussian(a.astype(float), s)
        dr, dc = np.gradient(g)
        rr, rc = np.gradient(dr)
        cc = np.gradient(dc)[1]
        rr, rc, cc = (x * s * s for x in (rr, rc, cc))
        root = np.sqrt(((rr - cc) / 2) ** 2 + rc**2)
        one, two = (rr + cc) / 2 - root, (rr + cc) / 2 + root
        small = np.where(np.abs(one) < np.abs(two), one, two)
        large = np.where(np.abs(one) < np.abs(two), two, one)
        blob = (small / np.where(large == 0, 1e-10, large)) ** 2
        structure = small**2 + large**2
        answer = np.exp(-blob / (2 * beta**2)) * (1 - np.exp(-structure / (2 * gamma**2)))
        best = np.maximum(best, np.where(large > 0, answer, 0))
    return best


def binary_pattern(a: np.ndarray, points: int = 24, radius: float = 3.0) -> np.ndarray:
    """Local binary pattern: a bit for each of ``points`` bilinear samples on a circle that reaches the centre's value."""
    h, w = a.shape
    r, c = np.mgrid[0:h, 0:w].astype(float)
    code = np.zeros(a.shape)
    for p in range(points):
        angle = 2 * np.pi * p / points
        rr, cc = r - np.round(radius * np.sin(angle), 5), c + np.round(radius * np.cos(angle), 5)
        r0, c0 = np.floor(rr).astype(int), np.floor(cc).astype(int)
        at = lambda i, j: np.where((i >= 0) & (i < h) & (j >= 0) & (j < w), a[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)], 0.0)
        fr, fc = rr - r0, cc - c0
        value = (1 - fr) * ((1 - fc) * at(r0, c0) + fc * at(r0, c0 + 1)) + fr * ((1 - fc) * at(r0 + 1, c0) + fc * at(r0 + 1, c0 + 1))
        code += (value >= a) * 2.0**p
    return code


def local_otsu(a: np.ndarray, radius: int) -> np.ndarray:
    """Otsu threshold of the bytes under a disk around each pixel.

    A row at a time: the histograms of all its disks are differences of running counts along the rows that they reach.
    """
    h, w = a.shape
    out = np.zeros(a.shape, int)
    k, columns = np.arange(256), np.arange(w)
    running: dict[int, np.ndarray] = {}
    for r in range(h):
        running.pop(r - radius - 1, None)
        counts = np.zeros((w, 256), np.int32)
        for dr in range(max(-radius, -r), min(radius, h - 1 - r) + 1):
            if r + dr not in running:
                one = np.zeros((w + 1, 256), np.int32)
                one[columns + 1, a[r + dr]] = 1
                running[r + dr] = one.cumsum(axis=0, dtype=np.int32)
            reach = int(np.sqrt(radius * radius - dr * dr))
            counts += running[r + dr][np.minimum(columns + reach + 1, w)] - running[r + dr][np.maximum(columns - reach, 0)]
        n = counts.astype(float)
        w1, s1 = n.cumsum(axis=1), (n * k).cumsum(axis=1)
        w2, s2 = w1[:, -1:] - w1, s1[:, -1:] - s1
        with np.errstate(invalid="ignore", divide="ignore"):
            between = np.where((w1 > 0) & (w2 > 0), w1 * w2 * (s1 / w1 - s2 / w2) ** 2, -1)
        # under a disk of one value, that value
        out[r] = np.where(between.max(axis=1) > 0, between.argmax(axis=1), counts.argmax(axis=1))
    return out


def png(layers: np.ndarray) -> bytes:
    """A picture of (height, width, 1 or 3) bytes."""
    import struct
    import zlib

    h, w, n = layers.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate((np.zeros((h, 1), np.uint8), layers.reshape(h, w * n)), axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """(height, width, channels) bytes of a picture of 8 bits a sample that is not interlaced; a palette becomes its colours."""
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG picture")
    at, head, palette, packed = 8, None, None, b""
    while at + 8 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("not a picture of 8 bits a sample, or interlaced")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error:
        raise ValueError("a damaged picture") from None
    if len(raw) != h * (w * n + 1):
        raise ValueError("a picture of another size than it says")
    lines = raw.reshape(h, w * n + 1)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.uint8)
    for r in range(h):
        kind, line = int(lines[r, 0]), lines[r, 1:].reshape(w, n)
        if kind == 0:
            above = line
        elif kind == 1:
            above = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            above = line + above
        else:
            above = _predicted(kind, line, above)
        out[r] = above
    return palette[out[:, :, 0]] if palette is not None and head[3] == 3 else out


def _predicted(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row whose bytes were taken less the mean of, or the nearest (Paeth) among, their neighbours."""
    if kind not in (3, 4):
        raise ValueError("no such filter")
    out = np.zeros(line.shape, np.int64)
    up = above.astype(np.int64)
    left = corner = np.zeros(line.shape[1], np.int64)
    for c in range(len(line)):
        if kind == 3:
            guess = (left + up[c]) // 2
        else:
            p = left + up[c] - corner
            a, b, d = abs(p - left), abs(p - up[c]), abs(p - corner)
            guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up[c], corner))
        left, corner = (line[c] + guess) % 256, up[c]
        out[c] = left
    return out.astype(np.uint8)


def boxes(labels: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first row, last row, first column, last column) of each label from 1 on."""
    r, c = np.nonzero(labels)
    n = int(labels.max()) if labels.size else 0
    own = labels[r, c] - 1
    low = [np.full(n, max(labels.shape)) for _ in range(2)]
    high = [np.zeros(n, int) for _ in range(2)]
    for k, x in enumerate((r, c)):
        np.minimum.at(low[k], own, x)
        np.maximum.at(high[k], own, x)
    return list(zip(low[0].tolist(), high[0].tolist(), low[1].tolist(), high[1].tolist()))


def outline(mask: np.ndarray) -> list[tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]]:
    """(outer ring, holes) of each component, as closed rings of pixel corners (x, y) along the pixels' edges."""
    found = []
    labels = label(mask, 4)
    for k, (top, bottom, left, right) in enumerate(boxes(labels), 1):
        own = np.pad(labels[top : bottom + 1, left : right + 1] == k, 1)
        follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, c in zip(*np.nonzero(own)):
            x, y = int(c) - 1 + left, int(r) - 1 + top
            for free, a, b in ((not own[r - 1, c], (x, y), (x + 1, y)), (not own[r, c + 1], (x + 1, y), (x + 1, y + 1)), (not own[r + 1, c], (x + 1, y + 1), (x, y + 1)), (not own[r, c - 1], (x, y + 1), (x, y))):
                if free:
                    follow.setdefault(a, []).append(b)
        rings = []
        while follow:
            start = min(follow)
            ring, at, before = [start], start, None
            while True:
                options = follow[at]
                # where two edges leave one corner, turn left so that rings of touching pixels stay apart
                nxt = options[0] if len(options) == 1 or before is None else min(options, key=lambda b: _turn(before, at, b))
                options.remove(nxt)
                if not options:
                    del follow[at]
                before, at = at, nxt
                ring.append(at)
                if at == start:
                    break
            rings.append(_straight(ring))
        area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2
        rings.sort(key=lambda ring: -abs(area(ring)))
        found.append((rings[0], rings[1:]))
    return found


def _turn(before, at, nxt) -> int:
    cross = (at[0] - before[0]) * (nxt[1] - at[1]) - (at[1] - before[1]) * (nxt[0] - at[0])
    return -cross


def _straight(ring):
    """The ring without corners that lie on a straight edge."""
    kept = [p for a, p, b in zip(ring[-2:-1] + ring[:-2], ring[:-1], ring[1:]) if (p[0] - a[0]) * (b[1] - p[1]) != (p[1] - a[1]) * (b[0] - p[0])]
    return [*kept, kept[0]]
