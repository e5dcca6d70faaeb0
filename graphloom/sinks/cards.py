"""Exports of a graph: Markdown cards, JSON, and a page with the map."""

from __future__ import annotations

import html
import json
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import NODE_KINDS

_ORDER = "start_line, end_line desc, id"


def file_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, symbols): the definitions of every file in reading order; files without any have none."""
    s = symbols.filter(~F.col("kind").isin(*NODE_KINDS)).select(
        "file_id",
        F.struct(
            "start_line", (-F.col("end_line")).alias("__end"), "id", "name", "kind", "end_line",
            F.coalesce("signature", F.lit("")).alias("signature"), "container",
        ).alias("s"),
    )
    per = s.groupBy("file_id").agg(F.array_sort(F.collect_list("s")).alias("symbols"))
    return files.select("file_id", "path").join(per, "file_id", "left")


def cards(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, card): one Markdown card per file."""
    line = lambda s: F.concat(
        F.lit("- `L"), s["start_line"].cast("string"), F.lit("-L"), s["end_line"].cast("string"), F.lit("` "), F.coalesce(s["kind"], F.lit("")), F.lit(" `"),
        F.when(s["container"].isNotNull(), F.concat(s["container"], F.lit("."))).otherwise(""), F.coalesce(s["name"], F.lit("")), F.lit("`: `"),
        F.replace(s["signature"], F.lit("`"), F.lit("\\`")), F.lit("`\n"),
    )
    body = F.array_join(F.transform(F.coalesce("symbols", F.array().cast("array<struct<start_line:bigint,__end:bigint,id:bigint,name:string,kind:string,end_line:bigint,signature:string,container:string>>")), line), "")
    return file_symbols(files, symbols).select("path", F.concat(F.lit("# "), F.col("path"), F.lit("\n\n"), body).alias("card"))


def export_markdown(files: DataFrame, symbols: DataFrame, destination: str, force: bool = False) -> int:
    """INDEX.md and files/NNNNN.md, streamed in path order; refuses to overwrite without ``force``."""
    index, folder = os.path.join(destination, "INDEX.md"), os.path.join(destination, "files")
    if os.path.exists(destination) and not os.path.isdir(destination):
        raise FileExistsError(f"{destination} is not a directory")
    for p in (index, folder):
        if os.path.exists(p) and not force:
            raise FileExistsError(f"{p} exists; use force to replace the export")
    shutil.rmtree(folder, ignore_errors=True)
    os.makedirs(folder)
    n = 0
    with open(index, "w", encoding="utf-8") as f:
        f.write("# Source graph export\n\n")
        for n, row in enumerate(cards(files, symbols).orderBy("path").toLocalIterator(), 1):
            f.write(f"- [{row['path']}](files/{n:05d}.md)\n")
            with open(os.path.join(folder, f"{n:05d}.md"), "w", encoding="utf-8") as card:
                card.write(row["card"])
    return n


def export_json(files: DataFrame, symbols: DataFrame, destination: str, force: bool = False) -> None:
    if os.path.exists(destination) and not force:
        raise FileExistsError(f"{destination} exists; use force to replace it")
    os.makedirs(os.path.dirname(os.path.abspath(destination)), exist_ok=True)
    keep = ("name", "kind", "start_line", "end_line", "signature", "container")
    with open(destination, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(file_symbols(files, symbols).orderBy("path").toLocalIterator()):
            entry = {"path": row["path"], "symbols": [{k: s[k] for k in keep} for s in row["symbols"] or []]}
            f.write(("," if i else "") + "\n" + json.dumps(entry, ensure_ascii=False, indent=2))
        f.write("\n]\n")


def page(title: str, answer: dict) -> str:
    """A self-contained page of a map."""
    e = html.escape
    dirs = "".join(
        f"<tr><td>{e(d['dir'])}</td><td>{d['files']}</td><td>{d['symbols']}</td><td>{e(', '.join(h['name'] for h in d['hubs']))}</td></tr>"
        for d in answer["dirs"]
    )
    hot = "".join(f"<li>{e(h['name'])} ({e(h['kind'])}): {h['in_degree']}</li>" for h in answer["hotspots"])
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"
        f"<p>{answer['files']} files, {answer['symbols']} symbols, {answer['edges']} edges; {answer['dropped_dirs']} more folders</p>"
        f"<table><tr><th>folder</th><th>files</th><th>symbols</th><th>hubs</th></tr>{dirs}</table><h2>Hotspots</h2><ol>{hot}</ol></body></html>\n"
    )


def serve(bind: str, body: str, allow_remote: bool = False):
    """A server of one page; refuses other than loopback addresses unless told to. Caller runs ``serve_forever``."""
    import ipaddress
    from http.server import BaseHTTPRequestHandler, HTTPServer

    host, _, port = bind.rpartition(":")
    if not allow_remote and not ipaddress.ip_address(host.strip("[]")).is_loopback:
        raise PermissionError(f"refusing to bind {bind}; allow_remote permits it")
    data = body.encode()

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            ok = self.path in ("/", "/index.html")
            out = data if ok else b"not found\n"
            self.send_response(200 if ok else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8" if ok else "text/plain; charset=utf-8")
            self.send_header("Content-Length", str(len(out)))
            self.send_header("X-Content-Type-Options", "nosniff")
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    return HTTPServer((host.strip("[]"), int(port)), Page)
