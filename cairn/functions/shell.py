"""What shell commands read and search."""

from __future__ import annotations

import posixpath
import re
import shlex
from itertools import groupby

# Programs that read files or search, and options that take a value.
READERS = "cat head tail less more bat nl sed awk".split()
SEARCHERS = "grep egrep fgrep rg ag ack".split()
VALUED = "-A -B -C -m -e -f -g -t -T -d -D --glob --type --include --exclude --max-count --context --regexp".split()
ENDS = "&& || ; | & |&".split()

# Programs and subcommands whose output is long, options that make it short, the mark that opts out, and what else is left alone.
LONG = "pytest py.test ctest make ninja tox nox sbatch srun mpirun".split()
LONG_SUB = [
    ("cmake", "--build"), ("cargo", "test"), ("cargo", "build"), ("go", "test"), ("go", "build"), ("npm", "test"), ("npm", "run"), ("yarn", "test"),
    ("pnpm", "test"), ("mvn", "test"), ("gradle", "test"), ("./gradlew", "test"), ("bazel", "test"), ("bazel", "build"),
]
QUIET = "-h --help --version --collect-only --co -n --dry-run --just-print".split()
OPT_OUT = "# raw"
UNSAFE = re.compile(r"\|(?!\|)|[<>`]|\$\(|(?<!&)&(?!&)")

_REDIRECTS = re.compile(r"[<>&]+\Z")
_ASSIGNS = re.compile(r"[A-Za-z_]\w*=")


def _tokens(command: str) -> list[str]:
    reader = shlex.shlex(re.sub(r"<<[\s\S]*", "", command).replace("\n", " ; "), posix=True, punctuation_chars=True)
    reader.whitespace_split = True
    try:
        return list(reader)
    except ValueError:
        return []


def simple_commands(command: str) -> list[tuple[list[str], bool]]:
    """(words, fed by a pipe) of each simple command.

    Redirections go with their targets and numbers, what follows a here-document mark is
    data, and a command with a substitution gives nothing, as what it reads isn't known.
    """
    if re.search(r"\$\(|`", command):
        return []
    out: list[tuple[list[str], bool]] = []
    before = ""
    for is_end, run in groupby(_tokens(command), key=ENDS.__contains__):
        run = list(run)
        if is_end:
            before = run[-1]
            continue
        points = [bool(_REDIRECTS.match(w)) for w in run]
        drops = {i + step for i, p in enumerate(points) if p for step in (0, 1)}
        drops |= {i - 1 for i, p in enumerate(points) if p and i and run[i - 1].isdigit()}
        words = [w for i, w in enumerate(run) if i not in drops]
        while words and _ASSIGNS.match(words[0]):
            del words[0]
        if words:
            out.append((words, before.startswith("|") and before != "||"))
    return out


def _plain(args: list[str]) -> tuple[list[str], dict[str, str]]:
    """Arguments that are no options, and the options that have a value."""
    valued = {a: b for a, b in zip(args, args[1:]) if a in VALUED}
    valued |= dict(a.split("=", 1) for a in args if a.startswith("--") and "=" in a)
    taken = {i + 1 for i, a in enumerate(args) if a in VALUED}
    return [a for i, a in enumerate(args) if i not in taken and (a == "-" or not a.startswith("-"))], valued


Found = tuple[str, str | None, str | None]  # pattern or None for a read, path, glob


def _searched(args: list[str]) -> list[Found]:
    free, valued = _plain(args)
    what = valued.get("-e") or valued.get("--regexp")
    if what is None:
        what, free = (free[0], free[1:]) if free else ("", [])
    glob = valued.get("-g") or valued.get("--glob") or valued.get("--include")
    return [(what, p, glob) for p in free or [None]] if what else []


def _found(args: list[str]) -> list[Found]:
    cut = next((i for i, a in enumerate(args) if a[:1] in ("-", "(", "!")), len(args))
    names = [b for a, b in zip(args, args[1:]) if a in ("-name", "-iname", "-path", "-ipath")]
    return [(names[0], p, None) for p in args[:cut] or [None]] if names else []


def label(pattern: str, path: str | None, glob: str | None, cwd: str = "/") -> str:
    """How a search is filed: its pattern, its place unless that is the root, its glob."""
    at = posixpath.normpath(posixpath.join(cwd, path or "."))
    return pattern + (f" path={at}" if at != "/" else "") + (f" glob={glob}" if glob else "")


def observations(command: str | None, cwd: str = "/") -> list[tuple[str, str]]:
    """(kind, value) of each file read and each search of a command; cd is followed, searches of a pipe don't count."""
    out: list[tuple[str, str]] = []
    for words, fed in simple_commands(command or ""):
        program, args = posixpath.basename(words[0]), words[1:]
        if program == "cd":
            cwd = posixpath.normpath(posixpath.join(cwd, args[0] if args else "/"))
        elif program in READERS and not (program == "sed" and any(a.startswith("-i") for a in args)):
            out += [("read", posixpath.normpath(posixpath.join(cwd, a))) for a in args if not a.startswith("-")]
        elif not fed:
            got = _searched(args[1:]) if program == "git" and args[:1] == ["grep"] else _searched(args) if program in SEARCHERS else _found(args) if program == "find" else []
            out += [("search", label(*x, cwd)) for x in got]
    return out


def tool_observations(tool: str | None, args: dict, cwd: str = "/") -> list[tuple[str, str]]:
    """(kind, value) of what a tool call reads and searches."""
    text = lambda k: v if isinstance(v := args.get(k), str) and v else None
    if tool == "Read" and text("file_path"):
        return [("read", posixpath.normpath(posixpath.join(cwd, text("file_path"))))]
    if tool in ("Grep", "Glob") and text("pattern"):
        return [("search", label(text("pattern"), text("path"), text("glob") if tool == "Grep" else None, cwd))]
    return observations(text("command"), cwd) if tool == "Bash" and text("command") else []


def _program(part: str) -> list[str]:
    """The words of one part of a command, without assignments before it and ``python -m``."""
    try:
        words = shlex.split(part)
    except ValueError:
        return []
    first = next((i for i, w in enumerate(words) if not _ASSIGNS.match(w)), len(words))
    words = words[first:]
    return words[2:] if len(words) > 2 and posixpath.basename(words[0]).startswith("python") and words[1] == "-m" else words


def is_long(command: str, wrapper: str) -> bool:
    """Whether a command prints much and may go through the wrapper.

    Pipes, redirections, substitutions and background runs leave it alone (an error stream
    sent to the output is none), as do quiet options, the mark that opts out and the wrapper itself.
    """
    if not command.strip() or OPT_OUT in command or wrapper in command:
        return False
    if UNSAFE.search(re.sub(r"\s2>&1\b", " ", command).replace("||", " ")):
        return False
    parts = [w for w in map(_program, re.split(r"&&|;|\|\|", command)) if w]
    if any(w in QUIET for words in parts for w in words):
        return False
    name = lambda w: w if w.startswith("./") else posixpath.basename(w)
    return any(name(w[0]) in LONG or (name(w[0]), *w[1:2]) in LONG_SUB for w in parts)


def routed(command: str, wrapper: str, moves: bool = False) -> str:
    """The command as one argument of the wrapper; with ``moves`` a leading cd into another place stays outside."""
    m = re.match(r"""\s*cd\s+('[^']*'|"[^"]*"|[^\s;&|]+)\s*&&\s*(\S[\s\S]*)\Z""", command) if moves else None
    run = lambda c: f"{shlex.quote(wrapper)} run -- bash -c {shlex.quote(c)}"
    return f"cd {m[1]} && {run(m[2].strip())}" if m else run(command)


def decision(tool: str, command: str | None, background: bool, mode: str, wrapper: str) -> tuple[str, str] | None:
    """(deny, ask or allow, the command to run instead) of a tool call, None where it is left alone."""
    if tool != "Bash" or not isinstance(command, str) or background or mode == "off" or not is_long(command, wrapper):
        return None
    return {"redirect": "deny", "rewrite": "allow"}.get(mode, "ask"), routed(command, wrapper)
