"""Scalar Column factories: rounding, encodings, colour, tiles, smooth steps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp((x - F.lit(float(lo))) / F.lit(float(hi - lo)), 0, 1)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def water_index(green: Column, infrared: Column) -> Column:
    """(green - infrared) / (green + infrared); null where both are 0."""
    return F.try_divide((green - infrared).cast("double"), (green + infrared).cast("double"))


def index_to_gray(index: Column) -> Column:
    return half_up((index + F.lit(1.0)) * F.lit(127.5)).cast("long")


def gray_to_index(gray: Column) -> Column:
    return gray / F.lit(127.5) - F.lit(1.0)


#: Heights of 0 to 2.5 m as codes 1 to 65534; 0 and 65535 are kept for other classes.
HEIGHT_MAX, HEIGHT_STEPS = 2.5, 65533


def encode_height(h: Column) -> Column:
    code = half_up(F.lit(1.0) + h / F.lit(HEIGHT_MAX) * F.lit(float(HEIGHT_STEPS)))
    return F.least(F.greatest(code, F.lit(1)), F.lit(HEIGHT_STEPS + 1)).cast("long")


def decode_height(code: Column) -> Column:
    return (code - 1) / F.lit(float(HEIGHT_STEPS)) * F.lit(HEIGHT_MAX)


def signed_height_code(h: Column) -> Column:
    """16-bit code of heights from -0.75 to 3.25 m."""
    return half_up(clamp((h + F.lit(0.75)) / F.lit(4.0), 0, 1) * F.lit(65535.0)).cast("long")


def high_byte(code: Column) -> Column:
    return F.shiftright(code, 8)


def low_byte(code: Column) -> Column:
    return code.bitwiseAND(F.lit(255))


def terrain_rgb(r: Column, g: Column, b: Column) -> Column:
    """Metres from the three bytes of a terrain tile."""
    return F.lit(-10000.0) + (r * 65536 + g * 256 + b) * F.lit(0.1)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)


def depth_shade(depth: Column) -> Column:
    """0 to 0.5 up to 15 m by a power curve, then smoothly to 1 at 40 m."""
    return F.when(depth <= 15, F.lit(0.5) * F.pow(F.greatest(depth, F.lit(0.0)) / F.lit(15.0), F.lit(0.6))).otherwise(F.lit(0.5) + F.lit(0.5) * smoothstep(15, 40, depth))


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(1 << zoom))).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    rad = lat * F.lit(math.pi / 180)
    return F.floor((F.lit(1.0) - F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad)) / F.lit(math.pi)) / F.lit(2.0) * F.lit(float(1 << zoom))).cast("long")


def ground_resolution(lat: Column, zoom: int) -> Column:
    """Metres a pixel of a 256-pixel tile."""
    return F.cos(lat * F.lit(math.pi / 180)) * F.lit(2 * math.pi * 6378137.0 / (256 * (1 << zoom)))


def chroma(r: Column, g: Column, b: Column) -> Column:
    """How far the largest channel stands above the smallest, as a share of it."""
    return F.coalesce(F.try_divide((F.greatest(r, g, b) - F.least(r, g, b)).cast("double"), F.greatest(r, g, b).cast("double")), F.lit(0.0))


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Twice what the largest of three bytes has over their mean, as a share of 255."""
    return (F.greatest(r, g, b) - (r + g + b) / F.lit(3.0)) * F.lit(2.0) / F.lit(255.0)


def frac(x: Column) -> Column:
    return x - F.floor(x)


def hash_noise(x: Column, y: Column) -> Column:
    """0 to 1 from a place, by the sine hash of shaders. Fixed values."""
    return frac(F.sin(x * F.lit(127.1) + y * F.lit(311.7)) * F.lit(43758.5453123))


def seed_hash(seed: Column) -> Column:
    """The same hash of one number."""
    return hash_noise(seed, F.lit(1.0))


def value_noise(x: Column, y: Column) -> Column:
    """hash_noise at the four whole places around, blended smoothly."""
    ix, iy = F.floor(x).cast("double"), F.floor(y).cast("double")
    ease = lambda t: t * t * (F.lit(3.0) - t * 2)
    ux, uy = ease(x - ix), ease(y - iy)
    corner = lambda i, j: hash_noise(ix + i, iy + j)
    return mix(mix(corner(0.0, 0.0), corner(1.0, 0.0), ux), mix(corner(0.0, 1.0), corner(1.0, 1.0), ux), uy)


def gradient_noise(x: Column, y: Column) -> Column:
    """Interleaved gradient noise (Jimenez 2014). Fixed values."""
    return frac(F.lit(52.9829189) * frac(x * F.lit(0.06711056) + y * F.lit(0.00583715)))


_WORD = (1 << 32) - 1


def word_product(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit words, in two halves so that nothing overflows."""
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return (a.bitwiseAND(F.lit(0xFFFF)) * b + high * 65536).bitwiseAND(F.lit(_WORD))


def mulberry(state: Column) -> Column:
    """0 to 1: the draw of the 32-bit generator mulberry32 whose state, after its step of 0x6D2B79F5, is given."""
    t = word_product(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + word_product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_WORD)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def mulberry_state(seed: Column, draw: Column) -> Column:
    """The state at the draw of that number (from 1): states are steps apart, so any draw is reached at once."""
    return (seed + word_product(draw.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(F.lit(_WORD))


def congruential(state: Column) -> Column:
    """The next state of the linear congruential generator of 31 bits."""
    return (state * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF))


def depth_of_shade(shade: Column) -> Column:
    """The inverse of depth_shade(): the smooth step's inverse has a closed form."""
    s = clamp((shade - F.lit(0.5)) * 2, 0, 1)
    deep = F.lit(15.0) + F.lit(25.0) * (F.lit(0.5) - F.sin(F.asin(F.lit(1.0) - s * 2) / 3))
    return F.when(shade < 0.5, F.lit(15.0) * F.pow(F.greatest(shade * 2, F.lit(0.0)), F.lit(5 / 3))).otherwise(deep)


def light(sun: Column, moon: Column, fraction: Column, gain: float = 1.0) -> dict[str, Column]:
    """Day factor, warmth, intensity and moonlight from the altitudes of Sun and Moon, and the tint of sunlight."""
    warm = clamp((F.lit(12.0) - sun) / 18, 0, 1)
    return {
        "day": clamp((sun + 6) / 11, 0, 1),
        "warm": warm,
        "intensity": F.lit(0.30) + F.lit(0.70) * clamp((sun + 4) / 26, 0, 1),
        "moonlight": F.least(F.lit(1.0), fraction * clamp((moon + 2) / 16, 0, 1) * F.lit(gain)),
        "red": F.lit(1.0) + F.lit(0.30) * warm,
        "green": F.lit(1.0) - F.lit(0.05) * warm,
        "blue": F.lit(1.0) - F.lit(0.34) * warm,
    }


def _smooth_between(lo: Column, hi: Column, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo), 0, 1)
    return t * t * (F.lit(3.0) - t * 2)


def damp(height: Column, tide: Column, past: Column, gain: float = 1.0, edge: float | None = None) -> Column:
    """How wet ground is that the tide has left since it stood at `past`: hard at the edges of that band, or smooth over `edge` metres."""
    if edge is None:
        band = ((past >= tide + F.lit(0.0004)) & (height >= tide) & (height <= past)).cast("double")
    else:
        e = F.lit(float(edge))
        band = _smooth_between(tide, tide + F.lit(0.004), past) * _smooth_between(tide - e, tide + e, height) * (F.lit(1.0) - _smooth_between(past - e, past + e, height))
    return clamp(band * (F.lit(1.0) - (height - tide) / F.greatest(past - tide, F.lit(1e-4))) * F.lit(gain), 0, 1)


def hex_channel(code: Column, channel: int) -> Column:
    """Red, green or blue (0, 1, 2) of a colour written as #rrggbb, 0 to 1."""
    return F.conv(F.substring(code, 2 + 2 * channel, 2), 16, 10).cast("double") / 255


def ramp(x: Column, stops: list[tuple[float, tuple[int, int, int]]], channel: int) -> Column:
    """A channel of the colour at x between stops, straight from one to the next; the end colours go on."""
    out = F.lit(float(stops[-1][1][channel]))
    for (a, ca), (b, cb) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < b, F.lit(float(ca[channel])) + F.lit(float(cb[channel] - ca[channel])) * clamp((x - F.lit(a)) / F.lit(b - a), 0, 1)).otherwise(out)
    return out


def chained(x: Column, first: float, steps: list[tuple[float, float, float]]) -> Column:
    """A value that passes smoothly to the next over each stretch (lo, hi, value) in turn."""
    out = F.lit(float(first))
    for lo, hi, value in steps:
        out = mix(out, F.lit(float(value)), smoothstep(lo, hi, x))
    return out


def filmic(c: Column, exposure: float, gamma: float) -> Column:
    """A byte from light: 1 - exp(-light), then a power."""
    return half_up(F.lit(255.0) * F.pow(clamp(F.lit(1.0) - F.exp(-c * F.lit(exposure)), 0, 1), F.lit(gamma))).cast("int")


def held_centre(c: Column, half: Column) -> Column:
    """A view's centre, moved so that its half width doesn't reach beyond the map."""
    return F.least(F.greatest(c, half), F.lit(1.0) - half)


#: Kilometres a degree, and the master grid's box (west, south, east, north).
KM_LAT, KM_LON = 110.574, 111.320
BOX = (175.93, -37.79, 176.37, -37.41)


def pixel_km2(box: tuple[float, float, float, float], across: int, down: int) -> float:
    """Ground area of a pixel of an equirectangular raster, at its middle latitude."""
    west, south, east, north = box
    return (east - west) * KM_LON * math.cos((north + south) / 2 * math.pi / 180) / across * (north - south) * KM_LAT / down


def lon_of(x: Column, across: int, box=BOX) -> Column:
    return F.lit(box[0]) + (x + F.lit(0.5)) / across * F.lit(box[2] - box[0])


def lat_of(y: Column, down: int, box=BOX) -> Column:
    return F.lit(box[3]) - (y + F.lit(0.5)) / down * F.lit(box[3] - box[1])


def x_of(lon: Column, across: int, box=BOX) -> Column:
    return half_up((lon - F.lit(box[0])) / F.lit(box[2] - box[0]) * across)


def y_of(lat: Column, down: int, box=BOX) -> Column:
    return half_up((F.lit(box[3]) - lat) / F.lit(box[3] - box[1]) * down)


def mercator(lat: Column) -> Column:
    """How far down a latitude lies on the square map of the world, 0 to 1."""
    return (F.lit(1.0) - F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360))) / F.lit(math.pi)) / F.lit(2.0)


def tile_lon(x: Column, zoom: int) -> Column:
    return x / F.lit(float(1 << zoom)) * 360 - 180


def tile_lat(y: Column, zoom: int) -> Column:
    return F.atan(F.sinh(F.lit(math.pi) - F.lit(2 * math.pi) * y / F.lit(float(1 << zoom)))) * F.lit(180 / math.pi)
