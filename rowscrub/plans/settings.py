"""The declarative workflow document."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from rowscrub.functions import patterns as P


@dataclass(frozen=True)
class Concat:
    name: str
    sources: tuple[str, ...]
    separator: str = ""


@dataclass(frozen=True)
class Workflow:
    """What to do with a table, by column name. Every part may be left out."""

    standalone: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    concatenations: tuple[Concat, ...] = ()
    regex_rules: Mapping[str, list[str]] = field(default_factory=dict)
    display_names: Mapping[str, str] = field(default_factory=dict)
    main_info: tuple[str, ...] = ()
    additional_info: tuple[Any, ...] = ()
    unique_columns: tuple[str, ...] = ()
    not_empty: tuple[str, ...] = ()
    year: int | None = None
    country_code: str = "ru"
    output_filename: str | None = None
    export: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, doc: Mapping[str, Any]) -> Workflow:
        columns = doc.get("columns") or {}
        structure = doc.get("structure") or {}
        return cls(
            standalone=tuple(columns.get("standalone", ())),
            exclude=tuple(columns.get("exclude", ())),
            concatenations=tuple(
                Concat(c["name"], tuple(c["source_columns"]), c["separator"]) for c in doc.get("concatenations", ())
            ),
            regex_rules=dict(doc.get("regex_rules") or {}),
            display_names=dict(doc.get("display_names") or {}),
            main_info=tuple(structure.get("main_info", ())),
            additional_info=tuple(structure.get("additional_info", ())),
            unique_columns=tuple((doc.get("dedup") or {}).get("unique_columns", ())),
            not_empty=tuple((doc.get("not_empty") or {}).get("columns", ())),
            year=doc.get("year"),
            country_code=doc.get("country_code", "ru"),
            output_filename=doc.get("output_filename"),
            export=dict(doc.get("export") or {}),
        )

    @classmethod
    def from_json(cls, text: str) -> Workflow:
        return cls.from_dict(json.loads(text))

    def check_patterns(self) -> None:
        for names in self.regex_rules.values():
            P.known(names, strict=True)

    def renamed(self, renames: Mapping[str, str], structure: bool = True) -> Workflow:
        """Carry column renames into the settings of the later steps."""

        def new(names):
            return tuple(renames.get(n, n) for n in names)

        def item(entry):
            if isinstance(entry, Mapping):
                return {k: list(new(v)) if isinstance(v, (list, tuple)) else v for k, v in entry.items()}
            return renames.get(entry, entry)

        changed = replace(self, unique_columns=new(self.unique_columns), not_empty=new(self.not_empty))
        if not structure:
            return changed
        main = tuple(n if n == "additional_info" else renames.get(n, n) for n in self.main_info)
        return replace(changed, main_info=main, additional_info=tuple(item(i) for i in self.additional_info))
