"""Image services: what an information document allows, and the largest image to ask for. Column expressions only.

Defined results
* a document of Image API 1, of none, or without positive sizes: null.
* several declared limits: the least counts; a height without a limit has the width's.
* a level 0 service that lists no size within its limits: null request.
* Retry-After that is no number: 2 to the power of the attempt; waits stay between 0 and ``MOST_WAIT`` seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_WAIT = 60.0
# Names of query parameters that hold a key, password or signature.
SECRET = r"(?i)([?&;][^=&;\s]*(?:key|token|secret|password|passwd|signature|credential|auth)[^=&;\s]*=)[^&;\s#]*"
_INFO = "`@context` string, type string, width long, height long, maxWidth long, maxHeight long, maxArea long, profile string, sizes array<struct<width:long,height:long>>"


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def image_info(document: Column) -> Column:
    """struct(api, width, height, level, max_width, max_height, max_area, sizes) of an information document, or null."""
    o = F.from_json(document, _INFO)
    api = F.when(o["@context"].contains("/image/3/") | (o["type"] == "ImageService3"), 3).when(o["@context"].contains("/image/2/"), 2)

    def least(name: str) -> Column:
        inner = F.regexp_extract_all(F.coalesce(o["profile"], F.lit("")), F.lit(rf'"{name}"\s*:\s*(\d+)'), 1)
        return F.array_min(F.filter(F.array_append(F.transform(inner, lambda x: x.try_cast("long")), o[name]), lambda x: x > 0))

    width, height = _positive(o["width"]), _positive(o["height"])
    max_width = least("maxWidth")
    info = F.struct(
        api.alias("api"), width.alias("width"), height.alias("height"), F.regexp_extract(F.coalesce(o["profile"], F.lit("")), r"level([012])", 1).try_cast("int").alias("level"),
        max_width.alias("max_width"), F.coalesce(least("maxHeight"), max_width).alias("max_height"), least("maxArea").alias("max_area"),
        F.filter(o["sizes"], lambda s: (s["width"] > 0) & (s["height"] > 0)).alias("sizes"),
    )
    return F.when(api.isNotNull() & width.isNotNull() & height.isNotNull(), info)


def within(info: Column, width: Column, height: Column) -> Column:
    """Whether the service gives an image of this size."""
    ok = (width <= info["width"]) & (height <= info["height"])
    return ok & (width <= F.coalesce(info["max_width"], width)) & (height <= F.coalesce(info["max_height"], height)) & (width * height <= F.coalesce(info["max_area"], width * height))


def image_size(info: Column) -> Column:
    """The size to ask for: ``max`` or ``full`` for the whole image, else ``w,`` of the largest that is allowed; null if none is."""
    w, h = info["width"], info["height"]
    listed = F.array_max(F.transform(F.filter(F.coalesce(info["sizes"], F.array().cast("array<struct<width:bigint,height:bigint>>")), lambda s: within(info, s["width"], s["height"])), lambda s: s["width"]))
    scale = F.least(F.coalesce(info["max_width"], w) / w, F.coalesce(info["max_height"], h) / h, F.sqrt(F.coalesce(info["max_area"], w * h) / (w * h)))
    top = F.greatest(F.lit(1), F.floor(w * scale)).cast("bigint")
    # rounding the height may overstep a limit by a pixel: the next smaller widths are tried
    tries = F.sequence(top, F.greatest(top - 8, F.lit(1).cast("bigint")), F.when(top > 1, F.lit(-1)).otherwise(F.lit(-1)).cast("bigint"))
    fits = F.filter(tries, lambda x: within(info, x, F.greatest(F.lit(1), F.round(h * x / w)).cast("bigint")))
    explicit = F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(1).cast("bigint"))
    chosen = F.when(info["level"] == 0, listed).otherwise(explicit)
    return F.when(info.isNull(), None).when(info["api"] == 3, F.lit("max")).when(within(info, w, h), F.lit("full")).when(chosen.isNotNull(), F.concat(chosen.cast("string"), F.lit(",")))


def image_request(service: Column, info: Column) -> Column:
    """Address of the whole image at the largest size the server allows, never above its own."""
    return F.concat(F.regexp_replace(service, r"/+$", ""), F.lit("/full/"), image_size(info), F.lit("/0/default.jpg"))


def redacted(text: Column) -> Column:
    """Addresses with the values of credential-like parameters replaced."""
    return F.regexp_replace(text, SECRET, "$1redacted")


def retry_wait(retry_after: Column, attempt: Column) -> Column:
    """Seconds to wait before an attempt."""
    own = F.trim(retry_after).try_cast("double")
    fallback = F.pow(F.lit(2.0), attempt)
    return F.least(F.greatest(F.when(own.isNotNull() & ~F.isnan(own) & (F.abs(own) < float("inf")), own).otherwise(fallback), F.lit(0.0)), F.lit(MOST_WAIT))
