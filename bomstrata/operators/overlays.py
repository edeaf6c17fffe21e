"""What adopters add to the licence tables: alias files, plug-ins and an external provider of names.

Layers, weakest first: names from providers, the curated tables, plug-ins, files. Files are named by the caller or by
the environment variable ``BOMSTRATA_LICENSE_OVERLAYS`` (separated as paths are); each is a mapping with ``aliases``,
``never_resolve`` and ``separators``. All of it is configuration of bounded size, read on the driver before any job.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from bomstrata.operators import licenses

FILES_VARIABLE = "BOMSTRATA_LICENSE_OVERLAYS"
PLUGINS, PROVIDERS = "bomstrata.license_overlays", "bomstrata.license_names"


def read_overlay(path: str) -> dict:
    """An overlay file, YAML or JSON; anything but a mapping is an error that names the file."""
    import yaml

    data = yaml.safe_load(Path(path).read_text("utf-8"))
    if data is not None and not isinstance(data, Mapping):
        raise TypeError(f"{path}: the top level has to be a mapping")
    return dict(data or {})


def _plugged(group: str) -> Iterable[Mapping]:
    """What the entry points of a group give, called where they can be; one that fails is left out."""
    from importlib.metadata import entry_points

    for e in entry_points(group=group):
        try:
            found = e.load()
            found = found() if isinstance(found, Callable) else found
        except Exception:  # noqa: BLE001, S112 - foreign code must not end the host
            continue
        if isinstance(found, Mapping):
            yield found


def tables(ids: Iterable[str] = (), files: Iterable[str] = (), overlays: Iterable[Mapping] = (), names: Mapping[str, str] | None = None) -> licenses.LicenseTables:
    """The licence tables with every layer merged in; later layers win key by key.

    ``ids``: further identifiers; ``overlays``: mappings as files hold them; ``names``: names from a provider, which the
    curated tables outrank.
    """
    named = [p for p in os.environ.get(FILES_VARIABLE, "").split(os.pathsep) if p]
    layers = [*_plugged(PLUGINS), *overlays, *map(read_overlay, (*named, *files))]
    weak = {k: v for source in (*_plugged(PROVIDERS), names or {}) for k, v in source.items() if k and v}
    merged = {part: {k: v for layer in layers for k, v in (layer.get(part) or {}).items()} for part in ("aliases", "separators")}
    refused = tuple(dict.fromkeys(str(x) for layer in layers for x in layer.get("never_resolve") or ()))
    t = licenses.tables_with(ids)
    t.names = dict(weak)
    t.aliases = {str(k): str(v) for k, v in merged["aliases"].items()}
    t.separators = tuple((str(k), f" {str(v).strip()} ") for k, v in merged["separators"].items())
    t.refuse = refused
    return t
