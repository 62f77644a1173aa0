"""Rule packs: the editable data that the text, site and family operators apply.

A pack is plain data.  ``demo`` is an original pack that suits the driver's
tables; real packs come from JSON files of the same shape through ``load``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class RulePack:
    version: str
    replacements: tuple[tuple[str, str], ...] = ()
    acronyms: tuple[str, ...] = ()
    accents: dict[str, str] = field(default_factory=dict)
    placeholders: tuple[str, ...] = ()
    brand_aliases: dict[str, str] = field(default_factory=dict)
    countries: tuple[str, ...] = ()
    country_rules: tuple[tuple[str, str], ...] = ()
    site_types: tuple[str, ...] = ()
    site_type_rules: tuple[tuple[str, str], ...] = ()
    default_site_type: str = ""
    available_types: tuple[str, ...] = ()
    flag_pattern: str = "(?!)"
    taxonomy: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    family_patterns: tuple[tuple[str, str], ...] = ()
    overriding: tuple[str, ...] = ()
    fallback: tuple[str, str] | None = None
    label_aliases: dict[str, str] = field(default_factory=dict)
    generic_families: tuple[str, ...] = ()
    bundle_family: str = "Bundles"
    staff_family: str = "Staff"

    def __post_init__(self) -> None:
        problems = []
        known = set(self.taxonomy)
        named = {f for f, _ in self.family_patterns} | {self.bundle_family}
        if known and named - known:
            problems.append(f"patterns of unknown families: {sorted(named - known)}")
        if set(self.label_aliases.values()) - known:
            problems.append(f"labels of unknown families: {sorted(set(self.label_aliases.values()) - known)}")
        if set(self.generic_families) - known:
            problems.append("unknown generic families")
        if {c for c, _ in self.country_rules} - set(self.countries):
            problems.append("rules of unknown countries")
        if {t for t, _ in self.site_type_rules} - set(self.site_types) or set(self.available_types) - set(self.site_types):
            problems.append("rules of unknown kinds of sites")
        prefixes = [(c, f) for _, c, f in self.taxonomy.values()]
        if len(set(prefixes)) != len(prefixes):
            problems.append("two families with one code prefix")
        for pattern in [*(p for p, _ in self.replacements), *(p for _, p in self.country_rules), *(p for _, p in self.site_type_rules), *(p for _, p in self.family_patterns)]:
            try:
                re.compile(pattern)
            except re.error as bad:
                problems.append(f"{pattern!r}: {bad}")
        if problems:
            raise ValueError("; ".join(problems))

    def code_prefix(self, family: str) -> str:
        _, category, own = self.taxonomy[family]
        return f"{category}-{own}"


def load(path: str | Path) -> RulePack:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    freeze = lambda v: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v
    raw["taxonomy"] = {k: tuple(v) for k, v in raw.get("taxonomy", {}).items()}
    return RulePack(**{k: freeze(v) for k, v in raw.items()})


demo = RulePack(
    version="demo-1",
    replacements=((r"\bpcs?\b\.?", "pieces"), (r"(\d)\s*(?:inch(?:es)?|\")", r"$1 in"), (r"\bw/\s*", "with "), (r"\s{2,}", " ")),
    acronyms=("LED", "USB", "HD"),
    accents={"cafe": "café", "senal": "señal"},
    placeholders=("NA", "NONE", "NULL", "SN", "0"),
    brand_aliases={"BRAND1": "Brand#01", "BRAND2": "Brand#02"},
    countries=("NATION_1", "NATION_2", "NATION_3"),
    country_rules=(("NATION_1", r"\bNORTH\b"), ("NATION_2", r"\bSOUTH\b"), ("NATION_3", r"\bWEST\b")),
    site_types=("warehouse", "branch", "repair", "transit", "rental", "office", "disposal"),
    site_type_rules=(("warehouse", r"[05]$"), ("branch", r"[16]$"), ("repair", r"[27]$"), ("transit", r"[38]$")),
    default_site_type="office",
    available_types=("warehouse", "branch"),
    flag_pattern=r"\bdo not use\b|\bobsolete\b|\bworthless\b|\btrash\b",
    taxonomy={
        "Rings": ("Hardware", "HW", "RNG"), "Widgets": ("Hardware", "HW", "WDG"), "Bolts": ("Hardware", "HW", "BLT"), "Gears": ("Drive", "DR", "GEA"),
        "Gizmos": ("Drive", "DR", "GIZ"), "Plates": ("Hardware", "HW", "PLT"), "Anvils": ("Tools", "TL", "ANV"), "Hot items": ("Tools", "TL", "HOT"), "Bundles": ("Bundles", "BN", "BUN"), "Staff": ("Services", "SV", "STF"),
    },
    family_patterns=(("Rings", r"\bRING\b"), ("Widgets", r"\bWIDGET\b"), ("Bolts", r"\bBOLT\b"), ("Gears", r"\bGEAR\b"), ("Gizmos", r"\bGIZMO\b"), ("Plates", r"\bPLATE\b"), ("Anvils", r"\bANVIL\b"), ("Hot items", r"\bHOT\b")),
    overriding=("Anvils",),
    fallback=("Bundles", r"\bLARGE\b"),
    label_aliases={"ECONOMY": "Bolts", "PROMO": "Bundles", "SMALL": "Rings", "STANDARD": "Gears"},
    generic_families=("Bolts",),
)
