"""Column expressions over text: repository addresses, id chains, lists, paths, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.clean import as_col

# Words that mark a change message as a repair.
REPAIR_WORDS = ["bug", "defect", "fix", "error", "repair", "patch", "issue", "exception"]


def repo_key(url: str | Column, lower: bool = True) -> Column:
    """Trim, drop trailing slashes, drop a ``.git`` ending; lower case on request."""
    text = F.regexp_replace(F.trim(as_col(url)), r"/+$", "")
    text = F.regexp_replace(text, r"(?i)\.git$", "")
    return F.lower(text) if lower else text


def https_url(url: str | Column) -> Column:
    """One scheme for git, http and scp-like addresses."""
    text = F.regexp_replace(F.trim(as_col(url)), r"^git@([^:/]+):", "https://$1/")
    return F.regexp_replace(text, r"^(git|http|ssh)://", "https://")


def owner_and_name(url: str | Column) -> Column:
    """Last two path parts of an address; empty when there are not two."""
    path = F.regexp_replace(repo_key(https_url(url)), r"^https://[^/]+", "")
    return F.regexp_extract(path, r"([^/?#]+/[^/?#]+)/*(?:[?#].*)?$", 1)


def repo_name(url: str | Column) -> Column:
    return F.element_at(F.split(repo_key(url, lower=False), "/"), -1)


def first_of_list(raw: str | Column, missing: str = "--") -> Column:
    """First token of a text split at the first separator kind it has: ``;``, ``,`` or space."""
    text = F.trim(as_col(raw))
    token = (
        F.when(F.instr(text, ";") > 0, F.split_part(text, F.lit(";"), F.lit(1)))
        .when(F.instr(text, ",") > 0, F.split_part(text, F.lit(","), F.lit(1)))
        .when(F.instr(text, " ") > 0, F.split_part(text, F.lit(" "), F.lit(1)))
        .otherwise(text)
    )
    token = F.trim(token)
    return F.when(~token.isin("", missing), token)


def stable_id(candidates: Sequence[str | Column], introduced: str | Column, row_no: str | Column) -> Column:
    """First non-blank id, else the introducing change, else the row number."""
    def filled(c: str | Column) -> Column:
        return F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))

    return F.coalesce(
        *[filled(c) for c in candidates],
        F.concat(F.lit("introduced:"), filled(introduced)),
        F.concat(F.lit("row_"), as_col(row_no).cast("string")),
    )


def split_list(raw: str | Column, separators: str = r"[;,\s]+") -> Column:
    """Trimmed, non-blank parts in order."""
    parts = F.split(F.coalesce(as_col(raw), F.lit("")), separators)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def parse_list(raw: str | Column) -> Column:
    """``['a','b']`` or ``a;b`` as an array; empty for a missing or malformed cell."""
    text = F.trim(F.coalesce(as_col(raw), F.lit("")))
    literal = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    none = F.array().cast("array<string>")
    return F.when(text.startswith("["), F.coalesce(literal, none)).otherwise(split_list(text, ";"))


def dedupe_keep_order(items: str | Column) -> Column:
    return F.array_distinct(as_col(items))


def path_safe(label: str | Column) -> Column:
    return F.regexp_replace(as_col(label), r"[^A-Za-z0-9._-]+", "_")


def scope_label(items: str | Column, shown: int = 5) -> Column:
    """Sorted names joined; a long list shows its head and how many follow."""
    names = F.array_sort(as_col(items))
    head = F.concat_ws("-", F.slice(names, 1, shown))
    return F.when(F.size(names) > shown, F.concat(head, F.lit("-plus"), (F.size(names) - shown).cast("string"))).otherwise(head)


def top_directory(path: str | Column) -> Column:
    return F.split_part(as_col(path), F.lit("/"), F.lit(1))


def parent_directory(path: str | Column) -> Column:
    return F.regexp_extract(as_col(path), r"^(.*)/[^/]*$", 1)


def extension(path: str | Column) -> Column:
    """Ending with its dot, lower case, empty for dot files and bare names."""
    return F.lower(F.regexp_extract(as_col(path), r"[^/](\.[^./]*)$", 1))


def is_repair_message(message: str | Column) -> Column:
    """Substring test, so ``prefix`` counts too."""
    return F.lower(as_col(message)).rlike("|".join(REPAIR_WORDS)).cast("int")


def from_first_hunk(patch: str | Column) -> Column:
    """Patch text from its first hunk line on; the whole text when there is none."""
    text = as_col(patch)
    hunk = F.regexp_extract(text, r"(?s)(?:^|\n)(@@.*)", 1)
    return F.when(hunk != "", hunk).otherwise(text)


def feature_signature(names: Sequence[str | Column]) -> Column:
    """Digest of names in their order; plain strings are column names, literals go in as columns."""
    return F.sha2(F.concat_ws("\n", *[as_col(n) for n in names]), 256)
