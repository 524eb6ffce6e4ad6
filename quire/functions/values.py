"""Numbers: colours, contrast, lengths, boxes of pages and pictures, statistics that vote. Column arithmetic throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Root size, page width and heights of the layout model; least contrast. Fixed values.
LEAST_CONTRAST = 4.5
PX_IN_PT = 0.75
BOX_PX = 0.45


def half_up(a: Column, b) -> Column:
    """a / b to the nearest whole number, halves up."""
    return F.floor((2 * a + b) / (2 * b)).cast("long")


def parse_color(text: Column) -> Column:
    """``#rgb``, ``#rgba``, ``#rrggbb``, ``#rrggbbaa``, ``rgb()`` and ``rgba()`` as 0xAARRGGBB; null if it is none."""
    t = F.lower(F.trim(text))
    digits = F.substring(t, 2, 8)
    doubled = F.regexp_replace(digits, "(.)", "$1$1")
    whole = F.when(F.length(digits) < 6, doubled).otherwise(digits)
    whole = F.when(F.length(whole) == 6, F.concat(whole, F.lit("ff"))).otherwise(whole)
    hexed = F.conv(F.concat(F.substring(whole, 7, 2), F.substring(whole, 1, 6)), 16, 10).cast("long")
    number = r"\s*([0-9]*\.?[0-9]+)(%?)\s*"
    rgb = rf"^rgba?\({number},{number},{number}(?:,{number})?\)$"

    def part(i: int) -> Column:
        v = F.regexp_extract(t, rgb, i).cast("double")
        v = F.when(F.regexp_extract(t, rgb, i + 1) == "%", v * 255 / 100).otherwise(v)
        return F.floor(F.least(v, F.lit(255.0)) + 0.5).cast("long")

    alpha = F.regexp_extract(t, rgb, 7)
    share = F.when(F.regexp_extract(t, rgb, 8) == "%", alpha.cast("double") / 100).otherwise(alpha.cast("double"))
    a = F.when(alpha == "", F.lit(255).cast("long")).otherwise(F.floor(F.least(share, F.lit(1.0)) * 255).cast("long"))
    of = lambda *v: v[0] * (1 << 24) + v[1] * (1 << 16) + v[2] * (1 << 8) + v[3]
    return F.when(t.rlike("^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), hexed).when(t.rlike(rgb), of(a, part(1), part(3), part(5)))


def channel(color: Column, shift: int) -> Column:
    return F.shiftright(color, shift).bitwiseAND(F.lit(255))


def over(front: Column, back: Column) -> Column:
    """A colour laid over an opaque one."""
    a = channel(front, 24) / 255.0
    mix = lambda s: F.floor(channel(front, s) * a + channel(back, s) * (1 - a) + 0.5).cast("long")
    return F.lit(0xFF << 24) + mix(16) * (1 << 16) + mix(8) * 256 + mix(0)


def over_white(color: Column) -> Column:
    return over(color, F.lit(0xFFFFFFFF))


def luminance(color: Column) -> Column:
    """Relative luminance, as contrast is defined by."""

    def linear(s: int) -> Column:
        c = channel(color, s) / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(16) + 0.7152 * linear(8) + 0.0722 * linear(0)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def parse_len(text: Column) -> Column:
    """struct(value, unit): em, pt (px are 3/4 of one) or percent; null if it is no length."""
    t = F.lower(F.trim(text))
    pattern = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(em|rem|pt|px|%)?$"
    v, u = F.regexp_extract(t, pattern, 1).cast("double"), F.regexp_extract(t, pattern, 2)
    value = F.when(u == "px", v * PX_IN_PT).otherwise(v)
    unit = F.when(u == "%", "percent").when(u.isin("px", "pt"), "pt").when(u.isin("em", "rem"), "em").when(v == 0, "em")
    return F.when(t.rlike(pattern) & unit.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def collapse(a: Column, b: Column) -> Column:
    """Two margins that meet."""
    return F.when((a >= 0) & (b >= 0), F.greatest(a, b)).when((a < 0) & (b < 0), F.least(a, b)).otherwise(a + b)


def line_height_ratio(height: Column, base: Column) -> Column:
    return F.greatest(height / base, F.lit(0.6))


def shown_line_height_ratio(height: Column, base: Column) -> Column:
    return F.greatest(height / base, F.lit(0.744))


def natural_px(text: Column, size: Column) -> Column:
    """How wide a text stands: East Asian characters an em, others half of one, 16 px an em, and 10 px."""
    wide = F.regexp_count(text, F.lit(r"[\x{1100}-\x{11FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}\x{20000}-\x{2FA1F}]"))
    return (wide + (F.length(text) - wide) * 0.5) * 16 * size + 10


def fit_page(w: Column, h: Column, width: int, height: int, up: Column, most: int = 3) -> Column:
    """struct(w, h) of a picture fitted to a canvas; it grows only where ``up`` says so, threefold at most."""
    wide = w * height >= h * width
    kept, big = (w <= width) & (h <= height) & ~up, (most * w <= width) & (most * h <= height)
    fit_w = F.when(kept, w).when(big, most * w).when(wide, F.lit(width)).otherwise(half_up(w * height, h))
    fit_h = F.when(kept, h).when(big, most * h).when(wide, half_up(h * width, w)).otherwise(F.lit(height))
    return F.struct(fit_w.cast("long").alias("w"), fit_h.cast("long").alias("h"))


def is_spread(w: Column, h: Column) -> Column:
    return 5 * w >= 6 * h


def spread_widths(w: Column) -> Column:
    """struct(left, right): the halves of a spread; the left one is the smaller."""
    left = F.floor(w / 2).cast("long")
    return F.struct(left.alias("left"), (w - left).alias("right"))


def gamma_table(gamma: float) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.floor(255 * F.pow(v / 255.0, F.lit(gamma)) + 0.5).cast("int"))


def autocontrast_table(low: Column, high: Column) -> Column:
    """The stretch of grey values to 0..255; null where there is little to stretch, or nothing."""
    table = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.greatest(F.least(F.floor((v - low) * 255.0 / (high - low) + 0.5), F.lit(255)), F.lit(0)).cast("int"))
    return F.when((high - low >= 159) & ~((low == 0) & (high == 255)), table)


def plausible_cover(kind: Column, w: Column, h: Column) -> Column:
    ratio = w / h
    return kind.isin("jpg", "png", "gif") & (h >= 300) & (w >= 180) & (ratio >= 0.45) & (ratio <= 1.05)


def is_comic(images: Column, chars: Column, tagged: Column) -> Column:
    return ((images >= 20) | (tagged & (images > 0))) & (chars < 40 * images)


def toc_like(link_chars: Column, chars: Column) -> Column:
    return (chars >= 1) & (2 * link_chars > chars)


def column_percents(widths: Column) -> Column:
    """Each width's share of their sum in percent, to 4 places, up to the first that is null."""
    total = F.aggregate(widths, F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0)))
    upto = F.array_position(F.transform(widths, lambda w: w.isNull()), True)
    known = F.when(upto > 0, F.slice(widths, F.lit(1), (upto - 1).cast("int"))).otherwise(widths)
    return F.transform(known, lambda w: F.round(100 * w / total, 4))


def vote_least(pages: Column) -> Column:
    """So many votes a slot of page numbers needs."""
    return F.greatest(F.lit(5), F.ceil(0.02 * pages))


def size_estimate(size: Column, grown: Column) -> Column:
    return F.ceil(F.when(grown, size * 2.1).otherwise(size)).cast("long")


def space_margin(total: Column) -> Column:
    return F.greatest(F.floor(total / 50), F.lit(50 << 20)).cast("long")


def shortfall(new: Column, old: Column, largest: Column, total: Column, free: Column) -> Column:
    """How much room is missing: what grows, or the largest staged file, and a margin, less what is free."""
    return F.greatest(F.greatest(new - old, F.lit(0)), largest) + space_margin(total) - free


def space_grew(new: Column, old: Column) -> Column:
    return new - old >= 50 << 20


def call_timeout(base_s: Column, size: Column) -> Column:
    """Seconds that a long call may take: twice the base, and a second each 256 KiB."""
    return 2 * base_s + size / (256 << 10)


def megabytes(size: Column) -> Column:
    return F.format_string("%.1f MB", size / 1e6)


def container_id(n: Column) -> Column:
    """An unsigned number as 28 characters of base 32."""
    return F.lpad(F.upper(F.conv(n.cast("string"), 10, 32)), 28, "0")


def weighted_mode(key: Column, weight: Column) -> Column:
    """An aggregate over rows (number, weight): the number of the most weight, the smaller one of equals."""
    return F.max_by(key, F.struct(weight, -key))


def trusted(value: Column, low: float, high: float, fallback: float) -> Column:
    """A mode in thousandths, if it lies between the bounds."""
    v = value / 1000.0
    return F.when(v.between(low, high), v).otherwise(F.lit(fallback))
