"""Schemas of the graph store."""

from __future__ import annotations

EXTRACT = (
    "symbols array<struct<name:string,kind:string,start_line:bigint,end_line:bigint,signature:string,search_text:string>>, "
    "calls array<struct<from:int,callee:string,receiver:string>>, "
    "bindings array<struct<owner:int,name:string,ty:string>>, "
    "containers array<string>, parents array<int>, imports array<string>"
)
FILES = "repo_id bigint, file_id bigint, path string, lang string, mtime bigint, size bigint, hash string"
SYMBOLS = (
    "repo_id bigint, file_id bigint, id bigint, ordinal int, name string, kind string, start_line bigint, end_line bigint, "
    "signature string, summary string, container string"
)
EDGES = "repo_id bigint, src bigint, dst bigint, kind string"

#: Symbols of one file that ids have room for; the file's own node is number 0.
SYMBOLS_PER_FILE = 1 << 20
