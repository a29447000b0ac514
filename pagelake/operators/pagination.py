"""Next pages by counter: a URL template, or a query parameter that counts up. Native expressions over a frontier."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.transforms import col


@dataclass(frozen=True)
class Counting:
    """How a listing counts its pages. `items` is a selector of what a page lists; a page without any is the last one."""

    template: str | None = None
    param: str | None = None
    start: int = 1
    step: int = 1
    page_size: int | None = None
    max_pages: int | None = None
    items: str | None = None

    def after(self, url, page) -> Column:
        """The page after `page` (counted from 1) at `url`; null if there is none."""
        to = from_template(self.template, page, self.start, self.step, self.page_size) if self.template else with_param(url, self.param, self.start, self.step)
        to = F.when(col(page) < self.max_pages, to) if self.max_pages else to
        return F.when(to != col(url), to)


def from_template(template: str, page, start: int = 1, step: int = 1, page_size: int | None = None) -> Column:
    """{page} is the number of the next page, {offset} that of the items before it."""
    n = col(page).cast("long")
    out = F.replace(F.lit(template), F.lit("{page}"), (start + n * step).cast("string"))
    return F.replace(out, F.lit("{offset}"), (n * (page_size or step)).cast("string"))


def with_param(url, param: str, start: int = 1, step: int = 1) -> Column:
    """url with its parameter counted up, or added; null where the parameter isn't a number."""
    u, name = col(url), re.escape(param)
    has = F.rlike(u, F.lit(rf"[?&]{name}="))
    now = F.when(has, F.regexp_extract(u, rf"[?&]{name}=([^&#]*)", 1).try_cast("long")).otherwise(F.lit(start).cast("long"))
    pair = F.concat(F.lit(f"{param}="), (now + step).cast("string"))
    base, rest = F.substring_index(u, "#", 1), F.regexp_extract(u, "(#.*)$", 1)
    added = F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), pair, rest)
    return F.when(has, F.regexp_replace(u, F.lit(rf"([?&]){name}=[^&#]*"), F.concat(F.lit("$1"), pair))).otherwise(added)
