"""All findings about a document at once: first its shape, then its meaning."""

from __future__ import annotations

import re
from typing import Any

from goldweave.functions.expressions import ExpressionError, check_expression, descendants

NAME = re.compile(r"[a-z][a-z0-9_]*\Z")


def schema_errors(raw: Any) -> list[tuple[str, str]]:
    """Problems of shape, as (JSON pointer, message)."""
    from goldweave.plans.model import KEYS, STRATEGIES, DocumentError, dialect

    out: list[tuple[str, str]] = []
    if not isinstance(raw, dict):
        return [("", "a document is a mapping")]
    try:
        kind = dialect(raw)
    except DocumentError as e:
        out += e.errors
        kind = "1" if str(raw.get("version", "")).startswith("1") else "2"
    keys = KEYS[kind]

    def known(value: Any, what: str, path: str, required: tuple[str, ...] = ()) -> bool:
        if not isinstance(value, dict):
            out.append((path, f"a {what} is a mapping"))
            return False
        out.extend((f"{path}/{k}", "unknown key") for k in value if k not in keys[what])
        out.extend((path, f"missing key {k!r}") for k in required if k not in value)
        return True

    def named(name: Any, path: str) -> None:
        if not isinstance(name, str) or not NAME.match(name):
            out.append((path, f"{name!r} is not a name: lower case letters, digits and _, a letter first"))

    known(raw, "doc", "", ("version", "sources", "targets", "mappings"))
    for part in ("sources", "targets"):
        if not isinstance(raw.get(part, {}), dict):
            out.append((f"/{part}", "must be a mapping"))
    for n, s in (raw.get("sources") or {}).items() if isinstance(raw.get("sources"), dict) else ():
        named(n, f"/sources/{n}")
        if known(s, "source", f"/sources/{n}", ("primary_key",)):
            pk = s.get("primary_key")
            if not (isinstance(pk, str) or kind == "1" and isinstance(pk, list) and pk and all(isinstance(c, str) for c in pk)):
                out.append((f"/sources/{n}/primary_key", "must be a column name" + " or a list of them" * (kind == "1")))
    for n, t in (raw.get("targets") or {}).items() if isinstance(raw.get("targets"), dict) else ():
        path = f"/targets/{n}"
        named(n, path)
        if not known(t, "target", path, ("identity", "fields") if kind == "2" else ("fields",)):
            continue
        if not isinstance(t.get("fields", {}), dict):
            out.append((f"{path}/fields", "must be a mapping"))
            continue
        for f, x in (t.get("fields") or {}).items():
            named(f, f"{path}/fields/{f}")
            if known(x, "field", f"{path}/fields/{f}", ("strategy",)) and x.get("strategy") not in STRATEGIES[kind] and "strategy" in x:
                out.append((f"{path}/fields/{f}/strategy", f"unknown strategy {x['strategy']!r}"))
        if kind == "2" and not isinstance(t.get("identity", []), list):
            out.append((f"{path}/identity", "must be a list"))
    if not isinstance(raw.get("mappings", []), list):
        out.append(("/mappings", "must be a list"))
        return out
    for i, m in enumerate(raw.get("mappings") or ()):
        path = f"/mappings/{i}"
        if not known(m, "mapping", path, ("name", "source", "target", "fields") if kind == "2" else ("name", "target")):
            continue
        if "name" in m:
            named(m["name"], f"{path}/name")
        if kind == "1" and "source" not in m and "parent" not in m:
            out.append((path, "needs a source or a parent"))
        for alias in m.get("parent_fields") or {}:
            named(alias, f"{path}/parent_fields/{alias}")
        for j, f in enumerate(m.get("fields") or ()):
            known(f, "map", f"{path}/fields/{j}", ("source", "target") if kind == "2" else ())
            if isinstance(f, dict) and f.get("direction", "bidirectional") not in ("bidirectional", "forward_only", "reverse_only"):
                out.append((f"{path}/fields/{j}/direction", f"unknown direction {f['direction']!r}"))
    return out


def semantic_errors(doc) -> list[tuple[str, str]]:
    """References that lead nowhere, and parts that don't fit together."""
    out: list[tuple[str, str]] = []
    v2 = doc.version == "2.0"
    for t in doc.targets.values():
        path = f"/targets/{t.name}"
        for g in t.identity:
            out += [(f"{path}/identity", f"unknown field {f!r}") for f in g if f not in t.fields]
        for f in t.fields.values():
            if f.references and f.references not in doc.targets:
                out.append((f"{path}/fields/{f.name}/references", f"unknown target {f.references!r}"))
            if f.strategy == "expression" and not f.expression:
                out.append((f"{path}/fields/{f.name}", "strategy expression needs an expression"))
            out += _unsafe(f.expression, f"{path}/fields/{f.name}/expression", query=True)
            out += _unsafe(f.default_expression, f"{path}/fields/{f.name}/default_expression")
            if f.from_ is not None or f.match:
                remote = doc.targets.get(f.from_ or "")
                if remote is None or f.strategy != "expression" or not f.match:
                    out.append((f"{path}/fields/{f.name}/from", "needs a target, strategy expression and match"))
                else:
                    out += [(f"{path}/fields/{f.name}/match", f"unknown field {x!r}") for x in [*(a for a in f.match if a not in remote.fields), *(b for b in f.match.values() if b not in t.fields)]]
            try:
                descendants(f.hierarchy)
            except ExpressionError as e:
                out.append((f"{path}/fields/{f.name}/hierarchy", str(e)))
        if not doc.into(t.name):
            out.append((path, "no mapping feeds this target"))
    out += _output_names(doc)
    names = [m.name for m in doc.mappings.values()]
    out += [("/mappings", f"{n!r} is declared twice") for n in {n for n in names if names.count(n) > 1}]
    for m in doc.mappings.values():
        path = f"/mappings/{m.name}"
        if m.source not in doc.sources:
            out.append((f"{path}/source", f"unknown source {m.source!r}"))
        if m.target not in doc.targets:
            out.append((f"{path}/target", f"unknown target {m.target!r}"))
            continue
        target = doc.targets[m.target]
        if m.parent is not None and m.parent not in doc.mappings:
            out.append((f"{path}/parent", f"unknown mapping {m.parent!r}"))
        if m.array and m.parent is None:
            out.append((path, "an array needs a parent"))
        if m.parent_fields and m.parent is None:
            out.append((f"{path}/parent_fields", "only a child has parent fields"))
        if v2:
            if m.parent and not m.array:
                out.append((path, "a parent needs an array"))
            used = {f.source for f in m.fields}
            out += [(f"{path}/parent_fields/{a}", "is not used by any field") for a in m.parent_fields if a not in used]
            for g in target.identity:
                out += [(path, f"identity field {f!r} is not mapped") for f in g if m.field_of(f) is None]
        for j, f in enumerate(m.fields):
            at = f"{path}/fields/{j}"
            if f.target is not None and f.target not in target.fields:
                out.append((f"{at}/target", f"unknown field {f.target!r} of {m.target}"))
            if f.references and f.references not in doc.mappings and f.references not in doc.targets:
                out.append((f"{at}/references", f"unknown mapping or target {f.references!r}"))
            if f.source is None and f.target is None:
                out.append((at, "neither source nor target"))
            if f.sources and (not f.join or f.direction != "bidirectional" or (f.split or {}).get("limit", 2) < 2):
                out.append((at, "several sources need a join, both directions, and a split limit of 2 or more"))
            if f.value_map is not None and (f.expression is not None or f.cast is not None):
                out.append((at, "value_map excludes a transform"))
            for name in ("expression", "reverse_expression", "normalize"):
                if isinstance(getattr(f, name), str):
                    out += _unsafe(getattr(f, name).replace("%s", "x"), f"{at}/{name}")
        if set(m.confirm) - {"insert", "update", "delete"}:
            out.append((f"{path}/confirm", "names actions: insert, update, delete"))
        for name in ("filter", "reverse_filter", "confirm_when"):
            if isinstance(getattr(m, name), str):
                out += _unsafe(getattr(m, name), f"{path}/{name}")
        for j, x in enumerate(m.links):
            if x.get("references") not in doc.mappings:
                out.append((f"{path}/links/{j}", f"unknown mapping {x.get('references')!r}"))
        out += [(f"{path}/sort", "excludes a field with order") for _ in m.sort[:1] if any(f.order for f in m.fields)]
        if any(f.order_prev for f in m.fields) != any(f.order_next for f in m.fields):
            out.append((path, "order_prev and order_next go together"))
        if m.derive_tombstones and m.derive_tombstones not in target.fields:
            out.append((f"{path}/derive_tombstones", f"unknown field {m.derive_tombstones!r}"))
        if (m.derive_noop or m.derive_timestamps) and not m.written_state:
            out.append((path, "derive_noop and derive_timestamps need written_state"))
    for i, t in enumerate(doc.tests):
        for s in t.get("input") or {}:
            if s not in doc.sources and not s.startswith(("_written_", "_cluster_members_")):
                out.append((f"/tests/{i}/input/{s}", "unknown source"))
        for s in t.get("expected") or {}:
            if s not in doc.sources and s not in doc.mappings:
                out.append((f"/tests/{i}/expected/{s}", "unknown mapping or source"))
    return out


def _output_names(doc) -> list[tuple[str, str]]:
    """Renamed output columns: known, distinct, and unlike any column that a result holds beside them."""
    from goldweave.plans.model import METADATA

    out = [(f"/output/{n}", "not an output column of the engine") for n in doc.output if n not in METADATA]
    called = [doc.named(n) for n in METADATA]
    out += [("/output", f"{n!r} is used twice") for n in sorted({n for n in called if called.count(n) > 1})]
    for m in doc.mappings.values():
        own = {f.source for f in m.fields if f.source} | set(m.passthrough) | (set(doc.sources[m.source].primary_key) if m.source in doc.sources else set())
        out += [(f"/mappings/{m.name}", f"column {n!r} is called as an output column of the engine; rename that under output:") for n in sorted(own & {doc.named(x) for x in ("_canonical_id", "_action", "_base", "_requires_confirmation")})]
    for t in doc.targets.values():
        out += [(f"/targets/{t.name}/fields/{n}", "is called as an output column of the engine") for n in t.fields if n in called]
    return out


def _unsafe(text: str | None, path: str, query: bool = False) -> list[tuple[str, str]]:
    if not text:
        return []
    try:
        check_expression(text, query=query)
    except ExpressionError as e:
        return [(path, str(e))]
    return []
