"""Line ranges of patches, and the functions that they meet."""

import difflib
import random

from lodestack.operators import hunks


def test_ranges_of_a_patch():
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,4 +1,5 @@ func f\n a\n-b\n+c\n+d\n e\n\\ No newline at end of file\n@@ -20,2 +21 @@\n-x\n y\n@@ -30,0 +31,2 @@\n+p\n+q\n@@ -40,2 +41,0 @@\n-r\n-s\n"
    assert hunks.ranges(patch) == [(2, 3), (21, 20), (31, 32), (42, 41)]
    assert hunks.ranges(None) == hunks.ranges("") == hunks.ranges("Binary files a and b differ\n+x\n") == []


def test_ranges_equal_a_plain_comparison():
    rng = random.Random(4)
    for _ in range(200):
        old = [f"{rng.randrange(6)}\n" for _ in range(rng.randrange(40))]
        new = [x if rng.random() < 0.8 else f"n{rng.randrange(6)}\n" for x in old if rng.random() < 0.9] + [f"{rng.randrange(6)}\n"] * rng.randrange(2)
        want = []
        for tag, _, _, a, b in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            if tag != "equal":
                want.append((a + 1, b))
        patch = "".join(difflib.unified_diff(old, new, "a", "b", n=rng.randrange(4)))
        assert hunks.ranges(patch) == want, patch


def test_touched_functions_equal_all_pairs(spark):
    rng = random.Random(5)
    functions, patches = [], []
    for i in range(300):
        start = rng.randrange(1, 1500)
        functions.append((rng.choice(["r", None]), f"f{rng.randrange(3)}.go", f"n{i}", start, start + rng.choice([0, 3, 60, 64, 400]), "extra"))
    for i in range(150):
        at, n = rng.randrange(1, 1500), rng.choice([0, 0, 1, 5, 200])
        patches.append((f"c{i % 20}", f"f{rng.randrange(4)}.go", f"@@ -{at},9 +{at},{n + 1} @@\n a\n-b\n" + "+c\n" * n + " d\n", rng.choice(["r", None])))
    patches += [("c0", None, "@@ -1 +1 @@\n+a\n", "r"), ("c0", "f0.go", None, "r"), patches[0]]
    f = spark.createDataFrame(functions, "repo_id string, file_path string, name string, start_line int, end_line int, bin string")
    d = spark.createDataFrame(patches, "commit string, path string, patch string, repo_id string")
    want = {(c, x[0], x[1], x[2]) for c, path, patch, repo in patches for a, b in hunks.ranges(patch) for x in functions if x[1] == path and x[0] == repo and x[3] <= b and x[4] >= a}
    got = [(r["commit"], r["repo_id"], r["file_path"], r["name"]) for r in hunks.touched_functions(f, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    without = {(c, x[0], x[1], x[2]) for c, path, patch, _ in patches for a, b in hunks.ranges(patch) for x in functions if x[1] == path and x[3] <= b and x[4] >= a}
    assert {(r["commit"], r["repo_id"], r["file_path"], r["name"]) for r in hunks.touched_functions(f.drop("bin"), d.drop("repo_id")).collect()} == without
    assert hunks.touched_functions(f.drop("bin").limit(0), d).count() == 0
