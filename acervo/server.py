"""The engine's commands as JSON over HTTP, for one machine.

``serve`` listens on the loopback address only.  Reading needs the right host;
changing needs the token too and runs one command at a time.  A rejected command
answers 400 with its reason, an unknown path 404; nothing else about an error
leaves the server.

    python -m acervo.server --root file:///data/store --pack rules.json --inbox /data/inbox --mart file:///data/mart
"""

from __future__ import annotations

import argparse
import base64
import hashlib
import io
import json
import secrets
import tarfile
import threading
from collections.abc import Callable, Iterator, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import BinaryIO
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from acervo.plans.pipeline import Engine, Rejected
from acervo.rulepack import demo, load
from acervo.sources import xlsx
from acervo.sources.store import StaleVersion

MOST_BYTES = 100 << 20  # of a request


def plain(value):
    """Rows, and lists and maps of them, as JSON values."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


class Pieces(io.RawIOBase):
    """A file object over pieces of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def read(self, n: int = -1) -> bytes:
        while n < 0 or len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                break
            self.held += piece
        n = len(self.held) if n < 0 else n
        out, self.held = self.held[:n], self.held[n:]
        return out


class Commands:
    """What a request may ask for: ``reads`` take the query's fields, ``changes`` the body's.

    Fixed values, the contract with clients: the paths, the token's header.
    """

    def __init__(self, engine: Engine, inbox: str, mart: str | None = None, sheet: str | None = None):
        self.engine, self.inbox, self.mart, self.sheet = engine, inbox.rstrip("/"), mart, sheet
        self.lock = threading.Lock()
        self.reads: dict[str, Callable[[dict], object]] = {"/api/state": self.state, "/api/search": self.search, "/api/product": lambda q: engine.detail(int(q["id"]))}
        self.free: dict[str, Callable[[dict], object]] = {"/api/propose": lambda d: engine.propose(d["name"], d.get("brand"), d.get("model"))}
        self.changes: dict[str, Callable[[dict], object]] = {
            "/api/import": self.receive, "/api/manual": self.create, "/api/standardize": self.standardize, "/api/sites": self.set_sites, "/api/link": self.link, "/api/unlink": self.unlink,
            "/api/review": self.review, "/api/technical": self.exclude, "/api/publish": self.publish,
        }

    def newest(self) -> int:
        found = self.engine.table("loads").agg(F.max("load_id")).first()[0]
        if not found:
            raise Rejected("there is no load yet")
        return found

    def exported(self, result) -> dict:
        out = plain(result) if isinstance(result, Mapping) else {"result": plain(result)}
        return out | ({"export": self.engine.refresh_export(self.mart)} if self.mart else {})

    def state(self, q: dict):
        return self.engine.state(int(q["load"]) if q.get("load") else None)

    def search(self, q: dict):
        rows, total = self.engine.search(q.get("q", ""), q.get("country"), q.get("status"), int(q.get("limit", 50)), int(q.get("offset", 0)), q.get("family"), q.get("category"))
        return {"total": total, "rows": rows}

    def receive(self, d: dict):
        """A sheet in the body: kept in the inbox under its content's digest, then taken all the way."""
        name, content = Path(d["filename"]).name, base64.b64decode(d["content"], validate=True)
        if not name.lower().endswith(".xlsx"):
            raise Rejected("an .xlsx file is needed")
        key = hashlib.sha256(content).hexdigest()
        own = xlsx.found_books(self.engine.spark, self.engine.store.put(f"{self.inbox}/{key}.xlsx", content))
        frame = xlsx.books(own, xlsx.header(own, self.sheet), self.sheet).drop("path")
        return self.engine.run(frame, d.get("source") or "upload", key, d.get("actor") or "people", d.get("reason") or "upload", self.mart)

    def archive(self, out: BinaryIO) -> None:
        """The exported mart as a tar archive, written piece by piece: no file is held whole."""
        store = self.engine.store
        with tarfile.open(fileobj=out, mode="w|") as tar:
            for name, size in store.files(self.mart):
                entry = tarfile.TarInfo(name)
                entry.size = size
                tar.addfile(entry, Pieces(store.chunks(f"{self.mart}/{name}")))

    def create(self, d: dict):
        made = self.engine.create(d["request_id"], d["name"], d.get("brand"), d.get("model"), bool(d.get("confirm_duplicate")), d.get("product_type", "ITEM"), d.get("site"), d.get("stock"), d.get("actor") or "people", d.get("reason") or "new product")
        return self.exported({"master_id": made})

    def standardize(self, d: dict):
        return self.exported(self.engine.standardise(int(d.get("load_id") or self.newest()), d.get("actor") or "people"))

    def set_sites(self, d: dict):
        changes = d.get("changes") or []
        if not changes:
            raise Rejected("no changes of sites")
        for i, c in enumerate(changes):  # the last one brings the stock along
            last = self.newest() if i == len(changes) - 1 else None
            self.engine.set_site(c["site"], c.get("country"), c.get("site_type"), d.get("actor") or "people", d.get("reason") or "confirmed", last)
        return self.exported({"saved": len(changes)})

    def link(self, d: dict):
        return self.exported({"link_id": self.engine.link(int(d["source_id"]), int(d["target_id"]), self.newest(), d.get("actor", ""), d.get("reason", ""))})

    def unlink(self, d: dict):
        self.engine.unlink(int(d["link_id"]), self.newest(), d.get("actor", ""), d.get("reason", ""))
        return self.exported({"unlinked": int(d["link_id"])})

    def review(self, d: dict):
        self.engine.review(int(d["master_id"]), d["decision"], d.get("family"), d.get("revision", ""), d.get("actor", ""), d.get("reason", ""))
        return self.exported({"saved": True})

    def exclude(self, d: dict):
        self.engine.exclude(int(d["load_id"]), int(d["row_number"]), d["decision"], d.get("actor", ""), d.get("reason", ""))
        return {"saved": True}

    def publish(self, d: dict):
        return self.engine.publish(int(d["load_id"]), d.get("token", ""), d.get("snapshot_at"), d.get("full_snapshot") is True, d.get("date_basis", "confirmed"), d.get("actor", ""), d.get("reason", ""))


def handler(commands: Commands, token: str) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            return

        def answer(self, code: int, body) -> None:
            data = json.dumps(plain(body), ensure_ascii=False, default=str).encode()
            self.send_response(code)
            for name, value in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def run(self, command: Callable[[], object]) -> None:
            try:
                self.answer(200, command())
            except (ValueError, KeyError, TypeError, StaleVersion) as refused:
                self.answer(400, {"error": str(refused)})
            except Exception:
                self.answer(500, {"error": "internal error"})
                raise

        @property
        def here(self) -> str:
            return f"127.0.0.1:{self.server.server_address[1]}"

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if self.headers.get("Host") != self.here:
                return self.answer(403, {"error": "unknown host"})
            if url.path == "/api/download":
                return self.download()
            command = commands.reads.get(url.path)
            if command is None:
                return self.answer(404, {"error": "unknown path"})
            self.run(lambda: command({k: v[0] for k, v in parse_qs(url.query).items()}))

        def download(self) -> None:
            if commands.mart is None:
                return self.answer(400, {"error": "nothing is exported"})
            self.send_response(200)
            self.send_header("Content-Type", "application/x-tar")
            self.send_header("Content-Disposition", 'attachment; filename="mart.tar"')
            self.send_header("Connection", "close")
            self.end_headers()
            with commands.lock:  # no command replaces the mart meanwhile
                commands.archive(self.wfile)
            self.close_connection = True

        def do_POST(self) -> None:
            known = self.headers.get("Host") == self.here and self.headers.get("Origin") in (None, f"http://{self.here}")
            if not known or not secrets.compare_digest(self.headers.get("X-Catalog-Token") or "", token):
                return self.answer(403, {"error": "not authorised"})
            size = int(self.headers.get("Content-Length") or 0)
            if not 0 < size <= MOST_BYTES:
                return self.answer(400, {"error": "an empty request, or one of more than 100 MB"})
            body = self.rfile.read(size)
            if self.path in commands.free:
                return self.run(lambda: commands.free[self.path](json.loads(body)))
            if self.path not in commands.changes:
                return self.answer(404, {"error": "unknown path"})
            with commands.lock:
                self.run(lambda: commands.changes[self.path](json.loads(body)))

    return Handler


def serve(commands: Commands, port: int = 0, token: str | None = None) -> tuple[ThreadingHTTPServer, str]:
    """A server on the loopback address (not yet serving) and its token."""
    token = token or secrets.token_urlsafe(32)
    return ThreadingHTTPServer(("127.0.0.1", port), handler(commands, token)), token


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name, default in (("--root", None), ("--pack", None), ("--inbox", "inbox"), ("--mart", None), ("--sheet", None)):
        parser.add_argument(name, default=default, required=name == "--root")
    parser.add_argument("--port", type=int, default=8766)
    args = parser.parse_args()
    engine = Engine(SparkSession.builder.getOrCreate(), args.root, load(args.pack) if args.pack else demo)
    engine.start(args.mart)
    server, token = serve(Commands(engine, args.inbox, args.mart, args.sheet), args.port)
    print(f"http://{server.server_address[0]}:{server.server_address[1]}/api/state  token {token}", flush=True)
    server.serve_forever()


if __name__ == "__main__":
    main()
