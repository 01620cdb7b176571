"""Which detectors and filters are on, and with what parameters."""

from __future__ import annotations

import contextlib
import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from .operators import detectors as D

#: On at first; the last two stay on when others are configured, unless they are disabled by name.
DEFAULT_FILTERS = [
    "is_sequential_string", "is_potential_uuid", "is_likely_id_string", "is_templated_secret", "is_prefixed_with_dollar_sign", "is_indirect_reference",
    "is_line_allowlisted", "is_lock_file", "is_not_alphanumeric_string", "is_swagger_file", "is_non_text_file", "is_invalid_file",
]
MANDATORY = ["is_invalid_file", "is_non_text_file"]
#: Accepted and kept, but nothing is done for them.
INERT = ["is_baseline_file", "is_ignored_due_to_verification_policies"]


def short(path: str) -> str:
    """A filter's own name out of a dotted path; the two that share one keep their module."""
    parts = path.split(".")
    return ".".join(parts[-2:]) if parts[-1].startswith("should_exclude_") and len(parts) > 1 else parts[-1]


def patterns_of(params: dict[str, Any]) -> list[str]:
    """The patterns of a filter, however they are given: ``pattern`` or ``patterns``, one or a list."""
    given = params.get("pattern", params.get("patterns", []))
    return [given] if isinstance(given, str) else list(given)


@dataclass
class Settings:
    plugins: dict[str, dict] = field(default_factory=dict)
    filters: dict[str, dict] = field(default_factory=lambda: {n: {} for n in DEFAULT_FILTERS})

    @classmethod
    def default(cls) -> Settings:
        """All built-in detectors and the filters that are on at first."""
        return cls({name: {} for name in D.KINDS})

    def clear(self) -> None:
        self.plugins = {}
        self.filters = {n: {} for n in DEFAULT_FILTERS}

    def configure_plugins(self, items: list[dict]) -> Settings:
        """Adds detectors: each a dict with ``name`` and its parameters."""
        for item in items:
            self.plugins[D.ALIASES.get(item["name"], item["name"])] = {k: v for k, v in item.items() if k != "name"}
        return self

    def disable_plugins(self, *names: str) -> Settings:
        for name in names:
            self.plugins.pop(D.ALIASES.get(name, name), None)
        return self

    def configure_filters(self, items: list[dict]) -> Settings:
        """Replaces the filters: each a dict with ``path`` and its parameters."""
        self.filters = {n: {} for n in MANDATORY} | {short(i["path"]): {k: v for k, v in i.items() if k != "path"} for i in items}
        return self

    def disable_filters(self, *paths: str) -> Settings:
        for path in paths:
            self.filters.pop(short(path), None)
        return self

    def set_filter(self, path: str, **params: Any) -> Settings:
        self.filters[short(path)] = params
        return self

    def configure_from_baseline(self, baseline: dict, filename: str = "") -> Settings:
        """Detectors of the baseline are added, its filters replace those here, and its own file is remembered."""
        self.configure_plugins(baseline.get("plugins_used", []))
        if "filters_used" in baseline:
            self.configure_filters(baseline["filters_used"])
        if filename:
            self.filters["is_baseline_file"] = {"filename": filename}
        return self

    def detectors(self) -> list[D.Detector]:
        """Those that are known; other names stay in the settings without effect."""
        known = [n for n in self.plugins if n in D.KINDS or n in D.CUSTOM]
        return [D.detector(n, **self.plugins[n]) for n in known]

    def as_dict(self) -> dict:
        plugins = [{"name": n} | p for n, p in sorted(self.plugins.items(), key=lambda x: x[0].lower())]
        filters = [{"path": n} | p for n, p in sorted(self.filters.items(), key=lambda x: x[0].lower()) if n not in MANDATORY]
        plugins = [{"name": p["name"]} | D.DEFAULTS.get(p["name"], {}) | p for p in plugins]
        return {"plugins_used": plugins, "filters_used": filters}

    def json(self) -> str:
        return json.dumps(self.as_dict())


_current = Settings()


def get_settings() -> Settings:
    """The settings that functions use when none are given."""
    return _current


def configure_settings_from_baseline(document: dict, filename: str = "") -> Settings:
    """The present settings with the detectors and filters of a baseline."""
    return _current.configure_from_baseline(document, filename)


def cache_bust() -> None:
    """The present settings as at first: no detectors, the first filters."""
    _current.clear()


def all_plugin_class_names() -> list[str]:
    return D.names()


def global_disable_plugins(names: list[str]) -> None:
    _current.disable_plugins(*names)


def global_disable_filters(paths: list[str]) -> None:
    _current.disable_filters(*paths)


def global_set_filter(path: str, config: dict[str, Any]) -> None:
    _current.set_filter(path, **config)


def global_set_plugin_limit(name: str, key: str, value: float) -> None:
    """Sets a number among the parameters of a detector, which is added if it isn't on."""
    _current.plugins.setdefault(D.ALIASES.get(name, name), {})[key] = value


def global_get_plugin_names() -> list[str]:
    return sorted(_current.plugins, key=str.lower)


def global_initialize_all_plugins() -> None:
    _current.plugins = {name: {} for name in D.KINDS}


def global_clear_plugins() -> None:
    _current.plugins = {}


@contextlib.contextmanager
def transient_settings(config: dict | Settings | None = None) -> Iterator[Settings]:
    """Other settings within a block; the former come back after it."""
    global _current
    before = _current
    if isinstance(config, Settings):
        _current = copy.deepcopy(config)
    else:
        _current = Settings()
        if config:
            _current.configure_from_baseline(config)
    try:
        yield _current
    finally:
        _current = before


def default_settings() -> contextlib.AbstractContextManager[Settings]:
    """All detectors and the first filters within a block."""
    return transient_settings(Settings.default())
