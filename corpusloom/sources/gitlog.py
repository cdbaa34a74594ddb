"""Commits mined from git repositories that executors can read, each repository by one ``git log`` read as a stream."""

from __future__ import annotations

import logging
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.commits import MODS

MINED = f"repo string, author array<string>, date string, timezone int, hash string, message string, mods {MODS}"
HEAD = "%x01%H%x00%an%x00%ae%x00%ad%x00%B%x02"
KINDS = {b"new file mode": "ADD", b"deleted file mode": "DELETE", b"rename from": "RENAME", b"copy from": "COPY"}
_MOD = pa.struct([(n, pa.string()) for n in ("change_type", "old_path", "new_path", "diff")])
_ARROW = pa.schema(
    [("repo", pa.string()), ("author", pa.list_(pa.string())), ("date", pa.string()), ("timezone", pa.int32()), ("hash", pa.string()), ("message", pa.string()), ("mods", pa.list_(_MOD))]
)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _offset(zone: str) -> int:
    """Seconds west of UTC of a zone like +0130."""
    seconds = int(zone[1:3]) * 3600 + int(zone[3:5]) * 60
    return seconds if zone[0] == "-" else -seconds


def _mod(header: list[bytes], body: list[bytes]) -> dict:
    """One file's change from the lines before its first hunk and those from there on."""
    kind, old, new = "MODIFY", None, None
    for line in header[1:]:
        for start, name in KINDS.items():
            if line.startswith(start):
                kind = name
        if found := re.match(rb'(?:(?:rename|copy) (from|to) |(---|\+\+\+) (?:"?[ab]/)?)(.*?)"?\t?\Z', line):
            path = None if found[3] == b"/dev/null" else _text(found[3])
            if found[1] == b"from" or found[2] == b"---":
                old = path
            else:
                new = path
    if old is None and new is None:  # binary, empty or of changed mode only: both names are the same
        names = header[0].removeprefix(b"diff --git ")
        old = new = _text(names[2 : len(names) // 2])
    old, new = None if kind == "ADD" else old, None if kind == "DELETE" else new
    return {"change_type": kind, "old_path": old, "new_path": new, "diff": _text(b"".join(line + b"\n" for line in body))}


def parse_log(lines: Iterator[bytes], max_lines: int | None) -> Iterator[dict]:
    """Commits of the output of ``git log -p`` in the format ``HEAD``; those that change more than ``max_lines`` lines
    are passed over, and no more than that is held of them."""
    commit, message, header, body, changed = None, None, [], [], 0

    def fits() -> bool:
        return max_lines is None or changed <= max_lines

    def close():
        if header and fits():
            commit["mods"].append(_mod(header, body))
        header.clear(), body.clear()

    for raw in lines:
        line = raw.removesuffix(b"\n")
        if line.startswith(b"\x01") and message is None:
            if commit:
                close()
                if fits():
                    yield commit
            digest, name, email, date, rest = line[1:].split(b"\x00", 4)
            day, clock, zone = _text(date).split(" ")
            commit = {"author": [_text(name), _text(email)], "date": f"{day} {clock}", "timezone": _offset(zone), "hash": _text(digest), "message": "", "mods": []}
            message, changed, line = [], 0, rest
        if message is not None:
            message.append(line.removesuffix(b"\x02"))
            if line.endswith(b"\x02"):
                commit["message"], message = _text(b"\n".join(message)).strip(), None
        elif line.startswith(b"diff --git "):
            close()
            header.append(line)
        elif header and not body and not line.startswith((b"@@", b"Binary files ")):
            header.append(line)
        elif header and line:
            changed += line.startswith((b"+", b"-"))
            if fits():
                body.append(line)
    if commit:
        close()
        if fits():
            yield commit


def mine_commits(repos: DataFrame, max_lines: int | None = 10_000, no_merges: bool = True, chunk: int = 25) -> DataFrame:
    """All commits, oldest first within a repository, of ``repos`` (repo 'org#name', path: a folder executors can read).

    A repository that git cannot read gives what came before the error, and a warning in the executor's log. An empty
    table gives an empty result. Leave out what is done with ``commits.without_done``. A repository is one task's work.
    """

    def run(batches):
        for batch in batches:
            for repo, path in zip(*(batch.column(i).to_pylist() for i in range(2))):
                command = ["git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-C", path or "", "log", "--reverse", "-p", "-M", "--no-color", "--no-ext-diff"]
                command += ["--date=format:%d.%m.%Y %H:%M:%S %z", f"--pretty=format:{HEAD}", *(["--no-merges"] if no_merges else [])]
                rows = []
                with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
                    for commit in parse_log(git.stdout, max_lines):
                        rows.append({"repo": repo, **commit})
                        if len(rows) >= chunk:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                if git.returncode:
                    logging.getLogger(__name__).warning("git failed on %s", repo)

    return repos.select(F.col("repo"), F.col("path")).repartition("repo").mapInArrow(run, MINED)
