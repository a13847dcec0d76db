"""Row schemas of the tables that the operators take and return."""

FILES = "repo_id string, path string, content string"
FUNCTION = "name string, start_line int, end_line int, loc int, complexity int, parameters array<string>, return_type string, is_exported boolean, comments string"
STRUCT = "name string, start_line int, end_line int, fields array<struct<name:string,type:string>>, is_exported boolean"
IMPORT = "path string, alias string"
ISSUES = "repo_id string, file_path string, type string, severity string, line int, message string, suggestion string"
EMBEDDINGS = "id string, repo_id string, file_path string, func_name string, start_line int, end_line int, code string, embedding array<float>, language string, provider string, dim int, error string"
COMMITS = "hash string, short_hash string, author string, email string, date timestamp, message string, parents array<string>"
DIFF_FILES = "commit string, path string, old_path string, status string, additions int, deletions int, patch string"
CONTENT = "commit string, path string, content string"


def array_of(fields: str) -> str:
    return f"array<struct<{','.join(':'.join(f.strip().split(' ', 1)) for f in _split(fields))}>>"


def _split(fields: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [*out, held]
