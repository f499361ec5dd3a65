"""Dashboard parameters (the reference's filter dict) as a frozen dataclass, and
their translation to one predicate (F10-F20)."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from .. import config as C


@dataclass(frozen=True)
class Filters:
    project: str = "all"
    category: str = "total"
    level: str = "discom"
    duration: str | None = None
    start_date: str | None = None      # 'YYYY-MM-DD'
    end_date: str | None = None
    dims: tuple = field(default_factory=tuple)   # (("discom", "ASIA%"), ...) case-insensitive ILIKE
    limit: int | None = None
    offset: int = 0

    def with_(self, **kw) -> "Filters":
        return replace(self, **kw)

    @classmethod
    def from_params(cls, params: dict, category_from_meter: bool = False) -> "Filters":
        """Build from a request-parameter dict: project, category, level,
        duration (alias period), start_date, end_date, limit, offset; every
        other non-empty key is a dimension filter (F10). om_category stands for
        meter_category where that is not given. meter_category is a filter beside
        the category; with ``category_from_meter`` (KPIs 13 and 14) it is the
        category where none is given."""
        p = {k: v for k, v in params.items() if v not in (None, "")}
        old = p.pop("om_category", None)
        if old and "meter_category" not in p:
            p["meter_category"] = old
        if category_from_meter and "category" not in p and str(p.get("meter_category", "")).lower() in C.CATEGORY_INPUTS:
            p["category"] = str(p.pop("meter_category"))
        known = {"project", "category", "level", "duration", "period", "start_date", "end_date", "limit", "offset"}
        dims = tuple((k, str(v)) for k, v in p.items() if k not in known)
        return cls(project=p.get("project", "all"), category=p.get("category", "total"),
                   level=p.get("level", "discom"), duration=p.get("duration", p.get("period")),
                   start_date=p.get("start_date"), end_date=p.get("end_date"), dims=dims,
                   limit=int(p["limit"]) if "limit" in p else None, offset=int(p.get("offset", 0)))

    @property
    def project_l(self) -> str:
        return (self.project or "all").lower()

    @property
    def category_l(self) -> str:
        c = (self.category or "total").lower()
        if c not in C.CATEGORY_INPUTS:
            raise ValueError(f"invalid category {self.category!r}")   # §2.14 #16
        return c

    @property
    def mapped_category(self) -> str | None:
        return C.CATEGORY_INPUT_MAP.get(self.category_l)


#: Rows of a list page: the default, and the most that may be asked for.
PAGE_ROWS, MAX_PAGE_ROWS = 1000, 50_000


def page_rows(f: "Filters") -> int:
    """Page size of the list endpoints."""
    n = PAGE_ROWS if f.limit is None else f.limit
    if not 1 <= n <= MAX_PAGE_ROWS:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE_ROWS}")
    return n


def normalise_level(level: str | None, allowed, default: str = "discom") -> str:
    """repair typos, unknown -> default."""
    lv = (level or default).lower()
    lv = C.LEVEL_TYPOS.get(lv, lv)
    return lv if lv in allowed else default


def normalise_duration(raw: str | None, default: str, allowed=("daily", "weekly", "monthly")) -> str:
    """period-type default / alias."""
    d = (raw or default).lower()
    if d in ("as_on", "latest_sat", "as", "ason", "snapshot"):
        return "as_on"
    return d if d in allowed else default
