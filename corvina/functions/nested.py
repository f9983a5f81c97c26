"""JSON of any shape."""

from __future__ import annotations

import hashlib
import json
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_list(raw: Column) -> Column:
    """A JSON list of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def nodes(value: Any):
    """All objects inside a value, outermost first. A stack, not recursion: depth is no limit."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def _loaded(raw: str | None) -> Any:
    try:
        return json.loads(raw) if raw else None
    except ValueError:
        return None


def values_of(key: str):
    """A column function: the distinct texts under a key anywhere in a JSON text, in order. Bad JSON gives an empty list."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(str(n[key]) for n in nodes(_loaded(r)) if n.get(key) not in (None, ""))) for r in raw])

    return run


@F.pandas_udf(T.StringType())
def canonical_json_sha256(raw: pd.Series) -> pd.Series:
    """Digest of JSON with sorted keys and no blanks, letters as they are: equal for equal content. Bad JSON gives null."""

    def one(r: str | None) -> str | None:
        v = _loaded(r)
        return None if v is None else hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return pd.Series([one(r) for r in raw], dtype=object)


def richness(columns: list[Column]) -> Column:
    """How many of the columns hold something."""
    return sum(((c.isNotNull() & (c.cast("string") != "")).cast("int") for c in columns), F.lit(0))


class _Scripts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.found, self.links, self.text = False, [], [], []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "script":
            self.inside = (a.get("type") or "").lower() == "application/ld+json"
            if self.inside:
                self.found.append("")
        if tag in ("script", "style"):
            self.skip += 1
        for name in ("src", "data-src", "content", "href"):
            if a.get(name) and (tag == "img" or (tag == "meta" and (a.get("property") or a.get("name") or "").lower() in ("og:image", "twitter:image")) or (tag == "link" and a.get("rel") == "image_src")):
                self.links.append((tag, a[name]))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.inside = False
            self.skip = max(0, self.skip - 1)

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.found[-1] += data
        elif not self.skip:
            self.text.append(data)


@F.pandas_udf(T.StructType([T.StructField("ld", T.ArrayType(T.StringType())), T.StructField("images", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))
def page_parts(pages: pd.Series) -> pd.DataFrame:
    """Of an HTML page: its JSON-LD objects, image links in order, visible text. Null and broken pages give what can be read."""
    rows = []
    for page in pages:
        p = _Scripts()
        p.feed(page or "")
        ld = [json.dumps(n, ensure_ascii=False) for s in p.found for n in nodes(_loaded(s)) if n.get("@type")]
        rows.append((ld, list(dict.fromkeys(u for _, u in p.links)), " ".join(" ".join(p.text).split())))
    return pd.DataFrame(rows, columns=["ld", "images", "text"])


# What an availability says, in small letters without signs; the first group that holds decides.
AVAILABILITY = [("out_of_stock", ["outofstock", "soldout", "discontinued"]), ("limited_stock", ["limitedavailability", "limitedstock", "lowstock"]), ("in_stock", ["instock"])]


def availability(value: Column) -> Column:
    """A stock state of what a page says about it: out_of_stock, limited_stock, in_stock or unknown."""
    bare = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")
    out = F.when(F.lit(False), "")
    for state, signs in AVAILABILITY:
        hit = F.lit(False)
        for sign in signs:
            hit = hit | bare.contains(sign)
        out = out.when(hit, state)
    return out.otherwise("unknown")


def stock_status(ld: Column, meta: Column) -> Column:
    """The first known state: of the offers of the products among a page's JSON-LD objects (texts), then of its meta tags' values."""
    said = F.flatten(F.transform(ld, lambda x: values_of_offers(x)))
    states = F.transform(F.concat(said, F.coalesce(meta, F.array().cast("array<string>"))), availability)
    return F.coalesce(F.try_element_at(F.filter(states, lambda x: x != "unknown"), F.lit(1)), F.lit("unknown"))


def values_of_offers(node: Column) -> Column:
    """The availabilities of a product node's offers, one offer or a list of them."""
    one, many = F.get_json_object(node, "$.offers.availability"), F.from_json(F.get_json_object(node, "$.offers"), "array<struct<availability:string>>")
    product = F.lower(F.coalesce(F.get_json_object(node, "$.@type"), F.lit(""))).contains("product")
    found = F.concat(F.array_compact(F.array(one)), F.array_compact(F.coalesce(F.transform(many, lambda o: o["availability"]), F.array().cast("array<string>"))))
    return F.when(product, found).otherwise(F.array().cast("array<string>"))


def srcset(value: Column) -> Column:
    """url and hint of every image of a srcset, in order. hint grows with the width (a 250th, 8 at most) or the density (twice, 6 at most)."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")

    def one(p: Column) -> Column:
        url, size = F.regexp_replace(p, r"\s+\S+$", ""), F.lower(F.regexp_extract(p, r"\s(\S+)$", 1))
        number = F.nullif(F.regexp_extract(size, r"^([0-9]*\.?[0-9]+)[wx]$", 1), F.lit("")).cast("double")
        hint = F.when(number.isNull(), 0.0).when(size.endswith("w"), F.least(number / 250, F.lit(8.0))).when(size.endswith("x"), F.least(number * 2, F.lit(6.0))).otherwise(0.0)
        return F.struct(url.alias("url"), hint.alias("hint"))

    return F.transform(parts, one)


def richest(key: str, fields: list[str]):
    """A column function: of all objects with the key anywhere in a JSON text the one with most of the fields filled, as JSON; the outermost
    of equals. Bad JSON and texts without such an object give null."""

    @F.pandas_udf(T.StringType())
    def run(raw: pd.Series) -> pd.Series:
        def one(r: str | None) -> str | None:
            found = [n for n in nodes(_loaded(r)) if n.get(key) not in (None, "")]
            best = max(found, key=lambda n: sum(n.get(f) not in (None, "", [], {}) for f in fields), default=None)
            return None if best is None else json.dumps(best, ensure_ascii=False, sort_keys=True)

        return pd.Series([one(r) for r in raw], dtype=object)

    return run


def object_or_empty(raw: Column) -> Column:
    """A JSON object as a map of texts; anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.ltrim(raw).startswith("{"), F.coalesce(F.from_json(raw, "map<string,string>"), empty)).otherwise(empty)
