"""JSON sidecars: reading, key spelling, references between files, detection of file types."""

from __future__ import annotations

import json
import posixpath
import re

from strandmill.catalog import LoadError
from strandmill.sources.files import Files

#: fixed values: file types and the readers that take them
TYPES = {
    "mutationVector": "mutation",
    "clinicalMatrix": "clinical",
    "clinicalFeature": "feature",
    "genomicMatrix": "genomic",
    "probeMap": "probemap",
    "genomicSegment": "segment",
    "genePredExt": "genepred",
    "genePred": "genepred",
}
#: fixed values: metadata keys in their own spelling
KEYS = ["probeMap", "shortTitle", "longTitle", "groupTitle", "platform", "security", "dataSubType", "text", "gain"]
SPELLING = {k.lower(): k for k in KEYS}


def sidecar(files: Files, path: str) -> dict | None:
    """The metadata beside a file, if there is any."""
    at = path + ".json"
    if not files.exists(at):
        return None
    try:
        doc = json.loads(files.text(at))
    except ValueError as e:
        raise LoadError(f"{at}: {e}") from e
    if not isinstance(doc, dict):
        raise LoadError(f"{at} holds no object")
    return doc


def canonical_key(key: str) -> str:
    """Lower case without a leading colon, or the known spelling of such a key."""
    k = re.sub("^:", "", key.lower())
    return SPELLING.get(k, k)


def canonical(meta: dict) -> dict:
    return {canonical_key(k): v for k, v in meta.items()}


def relative(root: str, path: str) -> str:
    """``path`` as seen from ``root``; an error if it lies outside."""
    root, path = posixpath.normpath(posixpath.join("/", root)), posixpath.normpath(posixpath.join("/", path))
    if root != "/" and not (path == root or path.startswith(root + "/")):
        raise LoadError(f"{path} is outside of {root}")
    return path[len(root) :].lstrip("/") if root != "/" else path.lstrip("/")


def reference_path(root: str, referrer: str, ref: str) -> str:
    """Where a reference points: absolute ones start at the root, others at the referring file."""
    base = root if ref.startswith("/") else posixpath.dirname(posixpath.join(root, referrer))
    return relative(root, posixpath.join(base, ref.lstrip("/")))


def references(root: str, referrer: str, meta: dict) -> dict[str, str | None]:
    """The entries whose keys start with a colon, as paths below the root."""
    return {k: None if v is None else reference_path(root, referrer, str(v)) for k, v in meta.items() if k.startswith(":")}


def detect_sidecar(files: Files, path: str) -> str | None:
    """By the type in the sidecar; without a type, a genomic matrix; an unknown type is none."""
    meta = sidecar(files, path)
    if meta is None:
        return None
    return TYPES.get(meta["type"]) if meta.get("type") else "genomic"


def detect_tsv(head: list[str]) -> str | None:
    """By the first two lines with text: both must have a tab."""
    some = [x for x in head if x.strip()][:2]
    return "tsv" if len(some) == 2 and all("\t" in x for x in some) else None


def detect(files: Files, path: str) -> str | None:
    """The kind of a file: the sidecar decides, else its first lines; None if neither does."""
    kind = detect_sidecar(files, path)
    if kind:
        return kind
    rows = files.spark.read.text(path).where("trim(value) <> ''").take(2)
    return detect_tsv([r[0] for r in rows])


# -- rewriting abstract names into paths ----------------------------------------
def object_table(docs: dict[str, dict]) -> dict[tuple[str, str], str]:
    """(type, name) -> file; a probe map is known by its group and assembly as well."""
    out: dict[tuple[str, str], str] = {}
    for file, m in sorted(docs.items()):
        kind, name = m.get("type"), m.get("name")
        if kind == "probeMap" and m.get("group"):
            out[kind, f"{m['group']}::{m.get(':assembly')}"] = file
        out[kind, name] = file
    return out


def rewrite_references(files: Files, root: str) -> dict[str, dict]:
    """Replace the abstract names in all sidecars below ``root`` by paths; returns the new metadata by file.

    A name that isn't found is tried as a group of the human assembly hg18.
    Files in the same folder are referred to by name, others from the root.
    """
    docs = {p[: -len(".json")]: json.loads(files.text(p)) for p in files.walk(root) if p.endswith(".json")}
    table = object_table(docs)
    out = {}
    for file, meta in docs.items():
        new = {}
        for k, v in meta.items():
            target = (table.get((k[1:], v)) or table.get((k[1:], f"{v}::hg18"))) if k.startswith(":") and isinstance(v, str) else None
            if target is None:
                new[k] = v
            elif posixpath.dirname(target) == posixpath.dirname(file):
                new[k] = posixpath.basename(target)
            else:
                new[k] = "/" + relative(root, target)
        if new != meta:
            files.write(file + ".json", json.dumps(new, indent=1))
        out[file] = new
    return out


# -- feature descriptions -----------------------------------------------------------
def parse_features(text: str) -> dict[str, dict]:
    """``feature attr value`` lines; ``state`` lines add up, ``stateOrder`` is a comma list with quotes.

    A feature with states gets ``order``: state -> code.
    """
    import csv

    out: dict[str, dict] = {}
    for line in text.split("\n"):
        cells = line.rstrip("\r").split("\t")
        if len(cells) < 2 or not line.strip():
            continue
        name, attr, value = cells[0], cells[1], cells[2] if len(cells) > 2 else None
        f = out.setdefault(name, {})
        if attr == "state":
            f.setdefault("state", []).append(value)
        elif attr == "stateOrder":
            f["stateOrder"] = next(csv.reader([value or ""], skipinitialspace=True), [])
        else:
            f[attr] = value
    for f in out.values():
        states = f.get("stateOrder") or f.get("state")
        if states:
            f["state"] = states
            f["order"] = {s: i for i, s in enumerate(states)}
    return out
