"""Manifests: numbered JSON files, each naming the segments that make up a store at one moment.

The newest valid manifest is the store's commit pointer: folders that it doesn't name don't exist for readers. A
generation is one above the largest number found, valid or not, so numbers never go back past a damaged file.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field

from .fs import Files

FOLDER = "manifests"


@dataclass(frozen=True)
class Segment:
    segment_id: int
    folder: str
    records: int
    bytes: int
    crc_sum: int
    crc_xor: int
    #: Least and greatest seq.
    low: int
    high: int


@dataclass(frozen=True)
class Manifest:
    generation: int
    next_seq: int
    segments: tuple[Segment, ...] = ()
    schema: str = ""
    #: Newest seq and folder of a checkpoint of the live set, if there is one.
    checkpoint: tuple[int, str] | None = None
    options: dict = field(default_factory=dict)

    def to_text(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})


def parse(text: str) -> Manifest | None:
    """The manifest, or None on any doubt."""
    try:
        outer = json.loads(text)
        if zlib.crc32(outer["body"].encode()) != outer["crc"]:
            return None
        found = json.loads(outer["body"])
        found["segments"] = tuple(Segment(**s) for s in found["segments"])
        found["checkpoint"] = tuple(found["checkpoint"]) if found["checkpoint"] else None
        return Manifest(**found)
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def generations(files: Files) -> list[int]:
    names = [n[9:-5] for n in files.names(FOLDER) if n.startswith("manifest-") and n.endswith(".json")]
    return sorted(int(n) for n in names if n.isdigit())


def load(files: Files, generation: int) -> Manifest | None:
    name = f"manifest-{generation:08d}.json"
    found = parse(files.read(FOLDER, name)) if files.exists(FOLDER, name) else None
    return found if found and found.generation == generation else None


def latest(files: Files) -> Manifest | None:
    """The newest valid manifest."""
    for g in reversed(generations(files)):
        if found := load(files, g):
            return found
    return None


def next_generation(files: Files) -> int:
    return max(generations(files), default=0) + 1


def publish(files: Files, manifest: Manifest) -> bool:
    """Make it the newest; False if another writer took the number."""
    files.make(FOLDER)
    return files.write_new(manifest.to_text(), FOLDER, f"manifest-{manifest.generation:08d}.json")
