"""Declarative rules a user writes. Checked on the driver; compiled to columns elsewhere."""

from __future__ import annotations

from dataclasses import dataclass, field

from webtables.functions.select import Selector

ALL = "*"  # wildcard step of a JSON path


@dataclass(frozen=True)
class Field:
    """How to read one field of an item, of the page, or of the page metadata."""

    select: Selector | None = None  # HTML
    path: tuple | None = None  # JSON: keys, indexes and ALL
    attr: str = "text"  # text | html | outer_html | an attribute name
    regex: str | None = None
    group: int = 0
    type: str = ""  # "" | string | int
    trim: bool = False
    multiple: bool = False
    required: bool = False
    default: str = ""
    on_missing: str = ""  # null | error | skip_item
    resolve_url: bool = False

    def __post_init__(self):
        if self.type.strip().lower() not in ("", "string", "int", "integer"):
            raise ValueError(f"unsupported field type {self.type!r}")
        if self.on_missing not in ("", "null", "error", "skip_item"):
            raise ValueError(f"unsupported on_missing {self.on_missing!r}")
        if self.default and self.is_int and not self.multiple:
            int(self.default)

    @property
    def is_int(self) -> bool:
        return self.type.strip().lower() in ("int", "integer")

    @property
    def missing_action(self) -> str:
        return self.on_missing or ("error" if self.required else "null")


@dataclass(frozen=True)
class Extract:
    """Three layers of fields; ``scope`` cuts the page into items."""

    fields: dict[str, Field] = field(default_factory=dict)
    page: dict[str, Field] = field(default_factory=dict)
    meta: dict[str, Field] = field(default_factory=dict)
    scope: Selector | tuple | None = None
    type: str = "html"

    @property
    def is_json(self) -> bool:
        return self.type.strip().lower() == "json"

    @property
    def reads_markup(self) -> bool:
        every = [*self.fields.values(), *self.page.values(), *self.meta.values()]
        return any(f.attr in ("html", "outer_html") for f in every)
