"""The mapping document: one internal model for both dialects.

Version 2 declares identity on the target as a list of groups; version 1 marks
identity fields by strategy and joins them into tuples by ``link_group``, and
keeps a row's own identity values when writing back.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

import yaml


class Loader(yaml.SafeLoader):
    """YAML 1.2 scalars: only true and false are booleans, and dates stay text."""


Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


class DocumentError(ValueError):
    """A document that can't be read or planned; ``errors`` lists every finding as (path, message)."""

    def __init__(self, errors: list[tuple[str, str]] | str):
        self.errors = [("", errors)] if isinstance(errors, str) else errors
        super().__init__("; ".join(f"{p or '/'}: {m}" for p, m in self.errors))


@dataclass(frozen=True)
class Source:
    name: str
    primary_key: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)
    table: str | None = None


@dataclass(frozen=True)
class Field:
    """A target field: its resolution strategy and what shapes its value."""

    name: str
    strategy: str = "coalesce"
    type: str | None = None
    references: str | None = None
    group: str | None = None
    default: Any = None
    default_expression: str | None = None
    expression: str | None = None
    link_group: str | None = None
    hierarchy: dict[str, str] = field(default_factory=dict)
    from_: str | None = None
    match: dict[str, str] = field(default_factory=dict)

    @property
    def element(self) -> str | None:
        """Type of the elements of a field that holds arrays."""
        return self.type[:-2] if self.type and self.type.endswith("[]") else None


@dataclass(frozen=True)
class Target:
    """``composites``: outputs that several fields make up together, as nested names of those fields."""

    name: str
    fields: dict[str, Field]
    identity: tuple[tuple[str, ...], ...]
    keep_own: bool = False
    elements: str | None = None
    composites: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class FieldMap:
    """One line of a mapping: where a value comes from, where it goes, and how it is written back."""

    source: str | None = None
    target: str | None = None
    source_path: str | None = None
    priority: int | None = None
    last_modified: Any = None
    references: str | None = None
    references_field: str | None = None
    direction: str = "bidirectional"
    expression: str | None = None
    reverse_expression: str | None = None
    reverse_required: bool = False
    normalize: Any = None
    order: bool = False
    order_prev: bool = False
    order_next: bool = False
    scalar: bool = False
    cast: str | None = None
    sources: tuple[str, ...] = ()
    split: dict | None = None
    join: dict | None = None
    value_map: dict | None = None
    reverse_value_map: dict | None = None
    value_map_fallback: str = "passthrough"
    null_wins: bool = False
    confirm: bool = False

    @property
    def forward(self) -> bool:
        return self.direction != "reverse_only" and self.target is not None

    @property
    def backward(self) -> bool:
        return self.direction != "forward_only"


@dataclass(frozen=True)
class Mapping:
    name: str
    source: str
    target: str
    fields: tuple[FieldMap, ...] = ()
    order: int = 0
    parent: str | None = None
    array: tuple[str, ...] = ()
    parent_fields: dict[str, Any] = field(default_factory=dict)
    last_modified: Any = None
    priority: int | None = None
    filter: Any = None
    reverse_filter: Any = None
    passthrough: tuple[str, ...] = ()
    soft_delete: dict | None = None
    derive_tombstones: str | None = None
    derive_noop: bool = False
    derive_timestamps: bool = False
    written_state: bool = False
    cluster_members: bool = False
    cluster_field: str | None = None
    links: tuple[dict, ...] = ()
    link_key: str | None = None
    sort: tuple[dict, ...] = ()
    include_base: bool = False
    confirm: dict[str, bool] = field(default_factory=dict)
    confirm_when: Any = None

    @property
    def gated(self) -> bool:
        """Do any of the mapping's deltas need confirmation?"""
        return bool(self.confirm) or self.confirm_when is not None or any(f.confirm for f in self.fields)

    @property
    def embedded(self) -> bool:
        return self.parent is not None and not self.array

    def field_of(self, target: str) -> FieldMap | None:
        """The first line that feeds a target field."""
        return next((f for f in self.fields if f.target == target and f.forward), None)

    @property
    def aliases(self) -> set[str]:
        return set(self.parent_fields)


@dataclass(frozen=True)
class Document:
    version: str
    sources: dict[str, Source]
    targets: dict[str, Target]
    mappings: dict[str, Mapping]
    tests: tuple[dict, ...] = ()
    description: str | None = None
    output: dict[str, str] = field(default_factory=dict)

    def named(self, column: str) -> str:
        """What the document calls one of the engine's own output columns."""
        return self.output.get(column, column)

    def into(self, target: str) -> list[Mapping]:
        return [m for m in self.mappings.values() if m.target == target]

    def children(self, mapping: str) -> list[Mapping]:
        return [m for m in self.mappings.values() if m.parent == mapping]

    def source_of(self, m: Mapping) -> Source:
        return self.sources[m.source]


#: Keys that each part of a document may have, by dialect.
KEYS = {
    "2": {
        "doc": {"version", "description", "sources", "targets", "mappings", "tests"},
        "source": {"primary_key"},
        "target": {"identity", "fields"},
        "field": {"strategy"},
        "mapping": {"name", "source", "target", "last_modified", "parent", "array", "parent_fields", "fields"},
        "map": {"source", "target", "priority", "references"},
    }
}
#: The engine's own output columns, which ``output:`` may rename.
METADATA = ("_canonical_id", "_action", "_mapping", "_src_pk", "_tombstone", "_soft_deleted", "_identity_hash", "_element_action", "_base", "_requires_confirmation")
KEYS["1"] = {
    "doc": KEYS["2"]["doc"] | {"name", "output"},
    "source": KEYS["2"]["source"] | {"fields", "description", "table"},
    "target": {"fields", "elements", "description"},
    "field": {"strategy", "type", "references", "group", "default", "default_expression", "expression", "link_group", "description", "element_type", "hierarchy", "from", "match"},
    "mapping": KEYS["2"]["mapping"] | {"priority", "filter", "reverse_filter", "passthrough", "soft_delete", "derive_tombstones", "derive_noop", "derive_timestamps", "written_state", "cluster_members", "cluster_field", "links", "link_key", "sort", "array_path", "include_base", "confirm", "confirm_when", "description"},
    "map": {f for f in FieldMap.__dataclass_fields__} | {"description", "transform", "target_path"},
}
STRATEGIES = {"2": {"coalesce", "last_modified"}, "1": {"identity", "coalesce", "last_modified", "expression", "collect", "multi_value", "bool_or", "any_true", "all_true"}}


def dialect(raw: Any) -> str:
    version = str(raw.get("version", "")) if isinstance(raw, dict) else ""
    if version not in ("2.0", "1.0"):
        raise DocumentError([("/version", f"unsupported version {version!r}; expected '2.0' or '1.0'")])
    return version[0]


def build(raw: dict) -> Document:
    """The model of a parsed document; raises DocumentError with every problem found."""
    from goldweave.plans.validate import schema_errors, semantic_errors

    errors = schema_errors(raw)
    if errors:
        raise DocumentError(errors)
    kind = dialect(raw)
    sources = {n: Source(n, tuple(pk) if isinstance(pk := s["primary_key"], list) else (pk,), {c: x["type"] for c, x in (s.get("fields") or {}).items() if "type" in x}, s.get("table")) for n, s in raw["sources"].items()}
    targets = {n: _target(n, t, kind, {f["target_path"] for m in raw["mappings"] if m.get("target") == n for f in m.get("fields") or () if "target_path" in f}) for n, t in raw["targets"].items()}
    mappings: dict[str, Mapping] = {}
    for i, m in enumerate(raw["mappings"]):
        mappings[m["name"]] = _mapping(m, i, mappings)
    doc = Document(str(raw["version"]), sources, targets, mappings, tuple(raw.get("tests") or ()), raw.get("description"), raw.get("output") or {})
    errors = semantic_errors(doc)
    if errors:
        raise DocumentError(errors)
    return doc


def _field(name: str, raw: dict) -> Field:
    """A target field; ``default:`` is a literal, ``{value: literal}`` or ``{sql: expression}``."""
    element = raw.get("element_type")
    raw = {"from_" if k == "from" else k: v for k, v in raw.items() if k not in ("description", "element_type")}
    if element is not None:
        raw["type"] = f"{element}[]"
    default = raw.get("default")
    if isinstance(default, dict) and "value" in default:
        raw["default"] = default["value"]
    elif isinstance(default, dict) and "sql" in default:
        raw["default"], raw["default_expression"] = None, default["sql"]
    return Field(name, **raw)


def part_name(path: str) -> str:
    """The field that holds one part of a composite output."""
    return path.replace(".", "__")


def _target(name: str, raw: dict, kind: str, paths: set[str]) -> Target:
    """A target; each part of an output that ``paths`` make up is a field of its own, resolved as the output says."""
    fields = {f: _field(f, x or {}) for f, x in raw["fields"].items()}
    composites: dict[str, dict] = {}
    for path in sorted(paths):
        root, *steps = path.split(".")
        if root not in raw["fields"] or not steps:
            raise DocumentError([(f"/targets/{name}", f"target_path {path!r} needs a field {root!r} and a part of it")])
        at = composites.setdefault(root, {})
        for s in steps[:-1]:
            at = at.setdefault(s, {})
        if not isinstance(at, dict) or steps[-1] in at:
            raise DocumentError([(f"/targets/{name}", f"target_path {path!r} is both a value and a part")])
        at[steps[-1]] = part_name(path)
        fields.pop(root, None)
        fields[part_name(path)] = _field(part_name(path), raw["fields"][root] or {})
    if kind == "2":
        return Target(name, fields, tuple((g,) if isinstance(g, str) else tuple(g) for g in raw["identity"]))
    groups: dict[str, list[str]] = {}
    for f in fields.values():
        if f.strategy == "identity":
            groups.setdefault(f.link_group or f"\0{f.name}", []).append(f.name)
    return Target(name, fields, tuple(tuple(g) for g in groups.values()), keep_own=True, elements=raw.get("elements"), composites=composites)


def _line(raw: dict) -> FieldMap:
    """One line; ``transform:`` holds a curated form or SQL, ``sources:`` several columns."""
    raw = {k: v for k, v in raw.items() if k != "description"}
    if "target_path" in raw:
        raw["target"] = part_name(raw.pop("target_path"))
    transform = raw.pop("transform", None)
    if isinstance(transform, dict) and set(transform) <= {"sql", "sparql"}:
        raw["expression"] = transform["sql"]
    elif isinstance(transform, dict):
        raw |= transform
    raw["sources"] = tuple(raw.get("sources") or ())
    return FieldMap(**raw)


def _mapping(raw: dict, order: int, known: dict[str, Mapping]) -> Mapping:
    raw = {k: v for k, v in raw.items() if k != "description"}
    if isinstance(raw.get("confirm"), bool):
        raw["confirm"] = dict.fromkeys(("insert", "update", "delete"), True) if raw["confirm"] else {}
    fields = tuple(_line(f) for f in raw.pop("fields", None) or ())
    path = raw.pop("array_path", None) or raw.pop("array", None)
    raw.pop("array", None)
    if "source" not in raw and raw.get("parent") in known:
        raw["source"] = known[raw["parent"]].source
    soft = raw.pop("soft_delete", None)
    soft = {"field": soft} if isinstance(soft, str) else soft
    for many in ("passthrough", "links", "sort"):
        if many in raw:
            raw[many] = tuple(raw[many] or ())
    # both spellings of a link's ends
    raw["links"] = tuple({"field": x.get("field", x.get("source_field")), "references": x.get("references", x.get("lookup_source"))} for x in raw.get("links", ()))
    return Mapping(fields=fields, order=order, array=tuple(str(path).split(".")) if path else (), soft_delete=soft, **raw)


def parse(text: str) -> Document:
    try:
        raw = yaml.load(text, Loader)
    except yaml.YAMLError as e:
        raise DocumentError(f"not YAML: {e}") from e
    return build(raw)


def load(path: str) -> Document:
    """A document from a file, or from all YAML files of a folder in path order."""
    if os.path.isdir(path):
        names = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith((".yaml", ".yml")))
        return build(merge([yaml.load(open(n, encoding="utf-8"), Loader) for n in names]))
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def merge(parts: list[dict]) -> dict:
    """One raw document from several; a name declared twice is an error."""
    out: dict[str, Any] = {}
    for part in parts:
        for key, value in (part or {}).items():
            if isinstance(value, dict):
                held = out.setdefault(key, {})
                twice = sorted(held.keys() & value.keys())
                if twice:
                    raise DocumentError([(f"/{key}/{n}", "declared twice") for n in twice])
                held.update(value)
            elif isinstance(value, list):
                held = out.setdefault(key, [])
                names = {x.get("name") for x in held if isinstance(x, dict)} - {None}
                twice = [x["name"] for x in value if isinstance(x, dict) and x.get("name") in names]
                if twice:
                    raise DocumentError([(f"/{key}/{n}", "declared twice") for n in twice])
                held.extend(value)
            elif out.setdefault(key, value) != value:
                raise DocumentError([(f"/{key}", "differs between files")])
    return out
