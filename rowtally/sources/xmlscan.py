"""XML documents read in chunks by many tasks: the lexer's state at each chunk's start, and the records each chunk holds.

Whether ``<item>`` is an element, or stands in a comment, CDATA, an instruction or a quoted value, hangs on all text before. So each
chunk is first summed up as a function: for every state it may start in, the state it ends in and what it does to the
stack of open elements. Composed over the chunks of a document these give each chunk's true start, and with that each
cuts its own records out of its text.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtally.session import scratch_folder, stored, working_session
from rowtally.sources.listing import feed_name, scanned_path

SPLIT_BYTES = 32 << 20  # text that a task reads, about
CHUNK_CHARACTERS = 1 << 20  # text of a chunk, about: what a task holds grows with a chunk, not with its split
CHILD = "rowtally_child"  # what records are called once they are cut out
AT = "rowtally_at"  # attribute of such a record: its place, document and own name

TEXT, COMMENT, CDATA, INSTRUCTION, DOCTYPE, DOUBLE, SINGLE = "text", "comment", "cdata", "instruction", "doctype", '"', "'"
_ENDS = {COMMENT: "-->", CDATA: "]]>", INSTRUCTION: "?>"}
_OPENERS = {"<!--": COMMENT, "<![CDATA[": CDATA, "<?": INSTRUCTION}
# inside a tag a value is quoted only behind an equals sign, and holds no "<"
_INSIDE = r"""(?:[^<>=]++|=\s*"[^"<]*"|=\s*'[^'<]*'|=(?!\s*"[^"<]*(?:"|\Z)|\s*'[^'<]*(?:'|\Z)))*+"""
_TAG_END = r"""(?:>|(?P<{0}>=\s*(?:"[^"<]*|'[^'<]*))\Z|(?P<{1}>(?=<)|\Z))"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z][^<>\[]*(?:\[(?:.*?\]\s*>|.*\Z)|>|\Z)"
    r"|</(?P<close>[^\s<>/]+)[^<>]*>|<(?P<open>[^\s<>/!?=]+)(?P<inside>" + _INSIDE + ")" + _TAG_END.format("cut", "stray"), re.S)
_REST = re.compile("(?P<inside>" + _INSIDE + ")" + _TAG_END.format("cut", "stray"), re.S)


def _event(m: re.Match, size: int) -> tuple[tuple[str, str, int, int], str]:
    """(kind, name, start, end) of a token and the state behind it. Kinds: open, empty, close, part (an open tag that isn't ended), other."""
    if m["close"]:
        return ("close", m["close"], m.start(), m.end()), TEXT
    if m["open"]:
        if m["cut"]:
            return ("part", m["open"], m.start(), m.end()), m["cut"].lstrip("= \t\r\n")[0]
        kind = "other" if m["stray"] is not None else "empty" if m["inside"].endswith("/") else "open"
        return (kind, m["open"], m.start(), m.end()), TEXT
    token, state = m[0], TEXT
    if m.end() == size:
        opener = next((o for o in _OPENERS if token.startswith(o)), None)
        if opener and not (token.endswith(_ENDS[_OPENERS[opener]]) and len(token) >= len(opener) + len(_ENDS[_OPENERS[opener]])):
            state = _OPENERS[opener]
        elif not opener and not re.search(r"\]\s*>\Z" if "[" in token else r">\Z", token):
            state = DOCTYPE
    return ("other", "", m.start(), m.end()), state


def _resume(text: str, state: str) -> tuple[int | None, list[tuple], str]:
    """Where plain text starts in a chunk that starts in ``state``, what the rest of a tag does, and the state then."""
    if state == TEXT:
        return 0, [], TEXT
    if state in _ENDS:
        at = text.find(_ENDS[state])
        return (None, [], state) if at < 0 else (at + len(_ENDS[state]), [], TEXT)
    if state == DOCTYPE:
        m = re.search(r"\]\s*>", text)
        return (m.end(), [], TEXT) if m else (None, [], state)
    at = text.find(state)
    if at < 0:
        return None, [], state
    m = _REST.match(text, at + 1)
    if m["cut"]:
        return None, [], m["cut"].lstrip("= \t\r\n")[0]
    return m.end(), [("rest empty" if m["inside"].endswith("/") else "rest open", "", 0, m.end())], TEXT


def lexed(text: str, state: str = TEXT, known: dict[int, int] | None = None) -> tuple[list[tuple], str, int | None]:
    """Events of a chunk that starts in ``state``, and the state at its end.

    ``known`` has the places of tokens found before: at the first that this way gets to as well, the rest is the same; its number is returned.
    """
    at, events, state = _resume(text, state)
    if at is None:
        return events, state, None
    for m in TOKEN.finditer(text, at):
        if known is not None and m.start() in known:
            return events, state, known[m.start()]
        event, state = _event(m, len(text))
        events.append(event)
    return events, state, None


def reduced(steps) -> list[tuple]:
    """What events do to the stack of open elements, without what opens and closes in between.

    An end tag closes all that is open in its element. One that finds nothing open here may close what was open before, so
    it stays a step of its own, and what comes later can't reach behind it.
    """
    out: list[tuple] = []
    for step in steps:
        kind, name = step[0], step[1]
        if kind == "close":
            i = len(out) - 1
            while i >= 0 and out[i][0] == "open" and out[i][1] != name:
                i -= 1
            if i >= 0 and out[i][0] == "open":
                del out[i:]
            else:
                out.append((kind, name, 0))
        elif kind in ("open", "rest open", "rest empty"):
            out.append((kind, name, step[2]))
    return out


def local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def chunk_map(text: str, wanted: set[str]) -> dict[str, list]:
    """For every start state: end state, steps on the stack, how many elements have each of the names ``wanted``, the name of the
    first element, and the open tag at the end."""
    events, end, _ = lexed(text)
    known = {e[2]: i for i, e in enumerate(events)}
    ways = {TEXT: ([], end, 0)}
    for state in (COMMENT, CDATA, INSTRUCTION, DOCTYPE, DOUBLE, SINGLE):
        ways[state] = lexed(text, state, known)
    # ways meet at few places; what follows from each is worked out once, from the last on
    marks = sorted({i for _, _, i in ways.values() if i is not None})
    tails: dict[int, tuple[list, Counter]] = {}
    steps: list[tuple] = []
    names: Counter = Counter()
    for i, j in reversed(list(zip(marks, [*marks[1:], len(events)]))):
        steps = reduced([*reduced(events[i:j]), *steps])
        names = names + _names(events[i:j], wanted)
        tails[i] = steps, names
    out = {}
    for state, (own, after, i) in ways.items():
        every = itertools.chain(own, itertools.islice(events, i, None) if i is not None else ())
        first = next((local(e[1]) for e in every if e[0] in _ELEMENTS), None)
        last = (own[-1:] if i is None or i == len(events) else events[-1:]) or [("",)]
        part = [last[0][1], last[0][2]] if last[0][0] == "part" else None
        rest, found = ([], Counter()) if i is None else tails[i]
        out[state] = [after if i is None else end, reduced([*reduced(own), *rest]), _names(own, wanted) + found, first, part]
    return out


_ELEMENTS = ("open", "empty", "part")


def _names(events: list[tuple], wanted: set[str]) -> Counter:
    return Counter(n for n in (local(e[1]) for e in events if e[0] in _ELEMENTS) if n in wanted)


def apply(steps: list, stack: list, part: list | None, block: int) -> list:
    """The stack of (name, block, place) behind a chunk. ``part`` is the open tag that the chunk before ended in."""
    stack = list(stack)
    for kind, name, at in steps:
        if kind == "open":
            stack.append([name, block, at])
        elif kind == "rest open" and part:
            stack.append(part)
        elif kind == "close":
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is not None:
                del stack[i:]
    return stack


def _starts(key: tuple[pa.Scalar, ...], chunks: pa.Table) -> pa.Table:
    """The true start of each chunk of a document, from the functions of those before, and the names of records in it.

    The first element of a document is its root, which is no record.
    """
    state, stack, part, root, out = TEXT, [], None, None, []
    for block, maps in sorted(zip(chunks["block"].to_pylist(), chunks["maps"].to_pylist())):
        end, steps, names, first, cut = json.loads(maps)[state]
        if root is None and first:
            root = first
            names[first] = names.get(first, 0) - 1
        out.append((key[0].as_py(), block, json.dumps([state, stack, part]), sorted(n for n, k in names.items() if k > 0)))
        stack = apply(steps, stack, part, block)
        part = [cut[0], block, cut[1]] if cut else part if end in (DOUBLE, SINGLE) else None
        state = end
    columns = list(zip(*out))
    return pa.table({"path": columns[0], "block": pa.array(columns[1], pa.int64()), "start": columns[2], "names": pa.array(columns[3], pa.list_(pa.string()))})


def cut_records(text: str, block: int, start: str, tag: str | None) -> list[tuple]:
    """(place's block, place, name, text, whole, holds) of what a chunk has of records.

    Records are elements whose local name is ``tag``, without one the children of the root. A record that starts or ends in
    another chunk isn't whole. A record in a record is one of its own, taken out of the outer one. ``holds`` says that a top
    element has records inside; it is then no record itself.
    """
    state, stack, part = json.loads(start)
    wanted = lambda name, depth: local(name) == tag if tag else depth == 1
    is_record = [wanted(e[0], i) for i, e in enumerate(stack)]
    texts: dict[tuple, list[str]] = {}
    holds: set[tuple] = set()
    out, at = [], 0

    def add(upto: int, key: tuple | None = None) -> None:
        """Text up to a place goes to the innermost open record, or to the one given."""
        nonlocal at
        if key is None:
            key = next((tuple(e) for e, r in zip(reversed(stack), reversed(is_record)) if r), None)
        if key is not None and upto > at:
            texts.setdefault(key, []).append(text[at:upto])
        at = max(at, upto)

    def done(key: tuple) -> None:
        out.append((key[1], key[2], key[0], "".join(texts.pop(key, [])), key[1] == block, key in holds))

    def begin(entry: list) -> None:
        if stack and is_record[0] and tag:
            holds.add(tuple(stack[0]))
        texts.setdefault(tuple(entry), [])

    events, end, _ = lexed(text, state)
    carried = part if part and wanted(part[0], len(stack)) else None
    for kind, name, first, last in events:
        if kind in ("rest open", "rest empty"):
            if carried:
                add(last, tuple(part))
            if part and kind == "rest open":
                is_record.append(carried is not None)
                stack.append(part)
            elif carried:
                done(tuple(part))
            carried = None
        elif kind in ("open", "empty", "part"):
            record = wanted(name, len(stack))
            entry = [name, block, first]
            if record:
                add(first)
                begin(entry)
            if kind == "open":
                stack.append(entry)
                is_record.append(record)
            elif record:
                add(last if kind == "empty" else len(text), tuple(entry))
                if kind == "empty":
                    done(tuple(entry))
        elif kind == "close":
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is None:
                continue
            while len(stack) > i + 1:  # elements without an end tag end here
                if is_record[-1]:
                    add(first)
                    done(tuple(stack[-1]))
                stack.pop()
                is_record.pop()
            if is_record[-1]:
                add(last)
                done(tuple(stack[-1]))
            stack.pop()
            is_record.pop()
    add(len(text), tuple(part) if carried else None)
    out += [(key[1], key[2], key[0], "".join(parts), False, key in holds) for key, parts in texts.items()]
    return out + [(key[1], key[2], key[0], "", False, True) for key in holds if key not in texts and key[1] != block]


def _chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, block, value``: text cut behind each ``>``, in the order of each split of a document."""
    session = working_session(spark, **{"spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES)})
    pieces = session.read.option("lineSep", ">").text(paths)
    return pieces.select(scanned_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _gathered(batches):
    """(path, block, text) of every chunk. Chunks of one split are numbered on from its offset; a split has more bytes than chunks."""
    now, parts, size, n = None, [], 0, 0
    for batch in batches:
        for *key, value in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now or size >= CHUNK_CHARACTERS:
                if parts:
                    yield now[0], now[1] + n, ">".join(parts) + ">"
                n = n + 1 if key == now else 0
                now, parts, size = key, [], 0
            parts.append(value)
            size += len(value) + 1
    if parts:
        yield now[0], now[1] + n, ">".join(parts) + ">"


def chunk_texts(spark: SparkSession, paths: list[str], tags: list[str]) -> DataFrame:
    """``path, block, text, maps`` of every chunk, stored, so that documents are put together and summed up once."""
    def summed(batches):
        for path, block, text in _gathered(batches):
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "text": [text], "maps": [json.dumps(chunk_map(text, set(tags)))]})

    return stored(_chunks(spark, paths).mapInArrow(summed, "path string, block bigint, text string, maps string"), scratch_folder(spark, "texts"))


def chunk_starts(chunks: DataFrame, folder: str) -> DataFrame:
    """``_file, path, block, start, names`` of every chunk; names are those of the tags summed up that elements in it have."""
    # dealt by a number of its own, or AQE would put the documents into few tasks for their small maps
    maps = chunks.select("path", "block", "maps").repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    starts = maps.groupBy("path").applyInArrow(_starts, "path string, block bigint, start string, names array<string>")
    return starts.select(feed_name(F.col("path"), folder).alias("_file"), "*")


def records(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """``tag, value``: every record as an element CHILD, whose attribute AT tells its place, own name and document.

    ``starts`` (_file, path, block, start, tag), tag null for the children of the root, has a row for each chunk.
    """
    schema = "_file string, path string, tag string, block bigint, at bigint, name string, seq bigint, text string, whole boolean, holds boolean"

    def cut(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one text at a time
                file, path, tag, block, start, text = (c[row].as_py() for c in batch.columns)
                rows = [(file, path, tag, b, at, name, block, t, whole, holds) for b, at, name, t, whole, holds in cut_records(text, block, start, tag)]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip([c.split()[0] for c in schema.split(", ")], map(list, zip(*rows)))), schema=arrow)

    arrow = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")])
    found = chunks.join(starts, ["path", "block"]).select("_file", "path", "tag", "block", "start", "text").mapInArrow(cut, schema)
    found = stored(found, scratch_folder(chunks.sparkSession, "cut"))  # whole records and pieces are told apart after one cut
    key = ["_file", "path", "tag", "block", "at", "name"]
    whole = found.filter("whole").select(*key, "text", "holds")
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")
    joined = found.filter("NOT whole").groupBy(*key).agg(pieces.alias("text"), F.bool_or("holds").alias("holds"))
    every = whole.unionByName(joined).filter("NOT holds")
    body = F.substring("text", F.length("name") + 2, F.length("text"))
    ends = F.regexp_extract("text", r"</([^\s<>/]+)[^<>]*>\z", 1) == F.col("name")
    alone = F.regexp_like(body, F.lit(r"\A[^<]*/>\z"))
    closed = F.when(alone, body).when(ends, F.regexp_replace(body, r"</[^<>]*>\z", f"</{CHILD}>")).otherwise(F.concat(body, F.lit(f"</{CHILD}>")))
    place = F.col("block").cast("decimal(38,0)") * F.lit(1 << 33).cast("decimal(11,0)") + F.col("at")
    mark = F.concat(F.lit(f'<{CHILD} {AT}="'), place.cast("string"), F.lit("|"), F.col("name"), F.lit("|"), F.url_encode("path"), F.lit('"'))
    return every.select(F.coalesce("tag", F.lit(CHILD)).alias("tag"), F.concat(mark, closed).alias("value"))
