"""Tools outside the engine: which of them a machine has, and trying several in turn.

A tool is looked for where a task runs, so executors may have tools that the driver lacks.
"""

from __future__ import annotations

import importlib.util
import os
import platform
import shutil
import subprocess
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

# Names under which browsers that print to PDF are installed, and what installs a tool.
BROWSERS = (
    "google-chrome", "google-chrome-stable", "chromium", "chromium-browser", "microsoft-edge", "microsoft-edge-stable", "brave-browser", "chrome", "msedge",
)
HINTS = {
    "pandoc": "install pandoc (https://pandoc.org/installing.html)",
    "pdftotext": "install poppler for pdftotext (poppler-utils)",
    "pymupdf": "pip install pymupdf",
    "pypdf": "pip install pypdf",
    "calibre": "install Calibre for ebook-convert (https://calibre-ebook.com/download)",
    "chrome": "install Chrome, Chromium, Edge or Brave, or name one in QUIRE_BROWSER",
    "wkhtmltopdf": "install wkhtmltopdf (https://wkhtmltopdf.org/downloads.html)",
    "weasyprint": "pip install weasyprint",
}
_APPLICATIONS = {"Google Chrome": "Google Chrome", "Chromium": "Chromium", "Microsoft Edge": "Microsoft Edge", "Brave Browser": "Brave Browser", "calibre": "ebook-convert"}


def on_path(*names: str) -> list[str] | None:
    """The command of the first of the names that is on the path."""
    return next(([at] for at in map(shutil.which, names) if at), None)


def module(name: str) -> list[str] | None:
    """How a Python module that can be imported is run; it is not imported here."""
    try:
        return [sys.executable, "-m", name] if importlib.util.find_spec(name) else None
    except (ImportError, ValueError, AttributeError):
        return None


def application(*names: str) -> list[str] | None:
    """An application that is installed outside the path."""
    if platform.system() == "Darwin":
        at = [Path(root, f"{n}.app/Contents/MacOS", _APPLICATIONS[n]) for root in ("/Applications", Path.home() / "Applications") for n in names]
    elif platform.system() == "Windows":
        roots = [os.environ.get(v) for v in ("ProgramFiles", "ProgramFiles(x86)", "LocalAppData")]
        parts = ("Google/Chrome/Application/chrome.exe", "Chromium/Application/chrome.exe", "Microsoft/Edge/Application/msedge.exe", "BraveSoftware/Brave-Browser/Application/brave.exe")
        at = [Path(root, part) for root in roots if root for part in parts] if "Chromium" in names else []
    else:
        at = []
    return next(([str(p)] for p in at if p.is_file() and os.access(p, os.X_OK)), None)


def browser() -> list[str] | None:
    """The one that QUIRE_BROWSER names, an installed application, or one on the path."""
    named = os.environ.get("QUIRE_BROWSER")
    return (on_path(named) if named else None) or application("Google Chrome", "Chromium", "Microsoft Edge", "Brave Browser") or on_path(*BROWSERS)


def run(command: Sequence[str], timeout: int, cwd: str | None = None) -> str:
    """Standard output of a command; a RuntimeError with the end of its complaint if it fails."""
    try:
        done = subprocess.run(list(command), capture_output=True, text=True, timeout=timeout, check=False, cwd=cwd)
    except subprocess.TimeoutExpired:
        raise RuntimeError(f"timed out after {timeout} s") from None
    except OSError as e:
        raise RuntimeError(f"could not run {command[0]}: {e}") from None
    if done.returncode:
        said = (done.stderr or done.stdout or "").strip().splitlines()[-3:]
        raise RuntimeError(" | ".join(said) or f"exit code {done.returncode}")
    return done.stdout


@dataclass(frozen=True)
class Way:
    """One of several ways to do a thing: a name, how its tool is found, and what it does with it."""

    name: str
    find: Callable[[], list[str] | None]
    do: Callable[..., str]


def first_way(ways: Sequence[Way], what: str, *args: object, wanted: str = "auto") -> tuple[str, str]:
    """(result, name) of the first way that is there and works; a RuntimeError with what each one said,
    and with hints, if none does.  wanted: only the way of that name."""
    said = []
    chosen = [w for w in ways if wanted in ("auto", w.name)]
    for way in chosen:
        tool = way.find()
        if tool is None:
            continue
        try:
            return way.do(tool, *args), way.name
        except Exception as e:  # noqa: BLE001 - whatever a tool does, the next one is tried and the reason kept
            said.append(f"{way.name}: {e}")
    hints = "; ".join(HINTS[w.name] for w in chosen)
    raise RuntimeError(f"{what}: {'; '.join(said) or 'no tool found'}. {hints}")


def capabilities() -> dict:
    """What this machine can convert and render; never fails."""
    from quire.sources import export, extract

    readers = [w.name for w in extract.PDF if w.find()]
    renderers = {w.name: found for w in export.RENDERERS if (found := w.find())}
    pandoc = on_path("pandoc")
    try:
        version = run([*pandoc, "--version"], 20).split("\n", 1)[0].split()[1] if pandoc else None
    except (RuntimeError, IndexError):
        version = None
    inputs = ["md", "markdown", "txt", "html", "htm", *(extract.PANDOC_FORMATS if pandoc else ()), *(["pdf"] if readers else [])]
    outputs = ["md", *(["html", "docx", "epub"] if pandoc else []), *(["pdf"] if pandoc and renderers else [])]
    lacking = {} if pandoc else {"pandoc": HINTS["pandoc"]}
    lacking |= {} if readers else {"pdf_input": "; ".join(HINTS[w.name] for w in extract.PDF)}
    lacking |= {} if renderers else {"pdf_output": "; ".join(HINTS[w.name] for w in export.RENDERERS)}
    return {
        "python": platform.python_version(), "platform": platform.system(), "pandoc": {"ok": bool(pandoc), "version": version, "path": pandoc[0] if pandoc else None},
        "pdf_extractors": readers, "pdf_renderers": {k: v[0] for k, v in renderers.items()}, "inputs": inputs, "outputs": outputs, "hints": lacking,
    }
