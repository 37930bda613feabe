"""Settings of a scan: a frozen dataclass with clamped values, and an INI reader."""

from __future__ import annotations

import configparser
from dataclasses import asdict, dataclass, fields, replace

#: Fixed value: the mask of reports.
DEFAULT_MASK = "sss**sss**sss**"
_CHOICES = {
    "parse_json": ("auto", "true", "false"),
    "prefilter": ("off", "regexp_field", "all"),
    "oversized_line_policy": ("truncate", "skip", "fail"),
    "encoding_errors": ("strict", "replace", "ignore"),
}
#: Least value of a number; severities also end at 5.
_LEAST = {
    "examplecount": 1, "minlen": 2, "critical": 1, "max_line_bytes": 1024, "max_total_findings": 1, "max_total_examples": 1,
    "max_values_per_pattern": 1, "max_examples_per_value": 1, "masked_value_criticality": 1,
    "regex_timeout_ms": 1, "regex_disable_threshold": 1,
}
_ALIASES = {"search_feld": "search_field", "max_examples": "max_examples_per_value"}
#: Settings of a single-machine scheduler that have no meaning on a cluster; accepted and ignored.
_IGNORED = {
    "workers", "refresh_status", "nocolor", "verbose", "max_auto_workers", "multiprocessing_min_total_bytes", "multiprocessing_min_file_count",
}


class ConfigError(ValueError):
    """An INI file with an unknown key or a value that is not allowed."""


def json_mode(value: object) -> str:
    text = str(value).strip().lower()
    if text in ("true", "on", "1", "yes"):
        return "true"
    return "false" if text in ("false", "off", "0", "no") else "auto"


@dataclass(frozen=True)
class ScanConfig:
    """Names and defaults of the settings."""

    examplecount: int = 10
    minlen: int = 4
    critical: int = 5
    anon: bool = True
    excelanon: bool = True
    full: bool = False
    show_sensitive_values: bool = False
    showskipped: bool = False
    anon_muster: str = DEFAULT_MASK
    search_regexp: bool = True
    search_field: bool = True
    search_suchmuster: bool = True
    parse_json: str = "auto"
    prefilter: str = "off"
    max_line_bytes: int = 1_048_576
    max_example_chars: int = 4000
    max_total_findings: int = 100_000
    max_total_examples: int = 20_000
    max_values_per_pattern: int = 10_000
    max_examples_per_value: int = 100
    masked_value_criticality: int = 4
    context_chars_before: int = 120
    context_chars_after: int = 120
    oversized_line_policy: str = "truncate"
    encoding: str = "auto"
    encoding_errors: str = "replace"
    follow_input_symlinks: bool = False
    regex_timeout_ms: int = 100
    regex_disable_threshold: int = 5

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("parse_json", json_mode(self.parse_json))
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                put(name, next(f.default for f in fields(self) if f.name == name))
        for f in fields(self):
            if isinstance(f.default, int) and not isinstance(f.default, bool):
                put(f.name, max(_LEAST.get(f.name, 0), int(getattr(self, f.name))))
        for name in ("critical", "masked_value_criticality"):
            put(name, min(5, getattr(self, name)))
        if self.show_sensitive_values:
            put("anon", False)
            put("excelanon", False)

    def as_dict(self) -> dict[str, object]:
        return asdict(self)


#: The rule files that an INI's [files] may name.
FILE_KEYS = ("regexp", "field", "suchmuster", "suchmuster_verzeichnis", "stopword_regexp", "stopword_field", "stopword_suchmuster")


def ini_files(text: str, strict: bool = True) -> dict[str, str]:
    """The rule files that INI text names in [files]; keys as FILE_KEYS."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    found = dict(parser["files"]) if parser.has_section("files") else {}
    for key in found.keys() - set(FILE_KEYS):
        if strict:
            raise ConfigError(f"unknown key: {key}")
        del found[key]
    return found


def load_ini(text: str, strict: bool = True, **explicit: object) -> ScanConfig:
    """Settings from INI text ([defaults]); explicit values go first. strict: unknown keys and bad values raise ConfigError,
    else they are left at their defaults."""
    parser = configparser.ConfigParser()
    parser.read_string(text)
    kinds, got = {f.name: f.default for f in fields(ScanConfig)}, {}
    section = parser["defaults"] if parser.has_section("defaults") else {}
    for key in section:
        name, raw = _ALIASES.get(key, key), section[key].strip()
        if name in _IGNORED:
            continue
        if name not in kinds:
            if strict:
                raise ConfigError(f"unknown key: {key}")
            continue
        try:
            if isinstance(kinds[name], bool):
                value: object = section.getboolean(key)
            elif isinstance(kinds[name], int):
                value = int(raw)
            else:
                value = json_mode(raw) if name == "parse_json" else raw
                if name in _CHOICES and value not in _CHOICES[name]:
                    raise ValueError(f"{key} must be one of {', '.join(_CHOICES[name])}")
        except ValueError as e:
            if strict:
                raise ConfigError(str(e)) from None
            continue
        if key not in _ALIASES or name not in got:
            got[name] = value
    return replace(ScanConfig(), **got | explicit)
