"""Settings of a run: env files, overrides, preconditions."""

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_env(text: str, outer: Mapping[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines; blank lines, comments and lines without ``=`` go. ``${NAME}`` is an earlier
    key or one of ``outer``, else empty. A later line wins."""
    known = dict(outer or {})
    own: dict[str, str] = {}
    for line in text.splitlines():
        key, equals, value = line.partition("=")
        key = key.strip()
        if not equals or not key or key.startswith("#"):
            continue
        own[key] = re.sub(r"\$\{(\w+)\}", lambda m: (known | own).get(m[1], ""), value.strip())
    return own


def first_set(*candidates: str | None) -> str | None:
    """The first that is neither None nor blank: a flag, then what surrounds the run, then nothing."""
    return next((c for c in candidates if c and c.strip()), None)


def options(defaults: Mapping[str, object], *overrides: Mapping[str, object]) -> dict[str, object]:
    """Later mappings win; an unknown name is an error rather than a setting without effect."""
    out = dict(defaults)
    for o in overrides:
        if unknown := sorted(set(o) - set(defaults)):
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        out |= o
    return out


def require(**capabilities: bool) -> None:
    """Stops a run that would only degrade every result."""
    if missing := sorted(k for k, there in capabilities.items() if not there):
        raise RuntimeError(f"missing: {', '.join(missing)}")


def in_scope(scopes: Column, wanted: str) -> Column:
    """True where the list of scopes names ``wanted`` anywhere; null reads as none."""
    return F.contains(F.coalesce(scopes, F.lit("")), F.lit(wanted))
