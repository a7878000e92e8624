from corvane.sources.diff import change_files, diff_lines, parse_patch

PATCH = """diff --git a/A.java b/A.java
--- a/A.java
+++ b/A.java
@@ -1,3 +1,3 @@ class A {
 one
-two
+  two
 three
diff --git a/old.txt b/new.txt
similarity index 90%
rename from old.txt
rename to new.txt
--- a/old.txt
+++ b/new.txt
@@ -5 +5,2 @@
-x
+y
+z
diff --git a/B b/B
new file mode 100644
--- /dev/null
+++ b/B
@@ -0,0 +1 @@
+-- dashes
\\ No newline at end of file
"""


def test_lines_are_numbered_on_both_sides():
    rows = [r for r in parse_patch(PATCH) if r[0] == "A.java"]
    assert [(r[5], r[6], r[7]) for r in rows] == [("context", 1, 1), ("del", 2, None), ("add", None, 2), ("context", 3, 3)]


def test_change_files(spark):
    files = change_files(diff_lines(spark.createDataFrame([("p", PATCH), ("q", None)], "patch string, text string")))
    got = {r.path: (r.old_path, r.status, r.additions, r.deletions, r.whitespace_only) for r in files.collect()}
    assert got == {"A.java": (None, "modified", 1, 1, True), "new.txt": ("old.txt", "renamed", 2, 1, False), "B": (None, "added", 1, 0, False)}


ODD = """diff --git a/plain.txt b/moved.txt
similarity index 100%
rename from plain.txt
rename to moved.txt
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
diff --git "a/d\\303\\251j\\303\\240.txt" "b/d\\303\\251j\\303\\240.txt"
--- "a/d\\303\\251j\\303\\240.txt"
+++ "b/d\\303\\251j\\303\\240.txt"
@@ -1 +1 @@
-a
+b
diff --git a/pic.png b/pic.png
new file mode 100644
Binary files /dev/null and b/pic.png differ
diff --git a/old b/kept
rename from old
rename to kept
--- a/old
+++ b/kept
@@ -1 +1 @@
-x
+y
--- plain/one.txt
+++ plain/one.txt
@@ -2 +2 @@
-p
+q
"""


def test_files_without_hunks_quoted_paths_and_plain_files_after_a_rename(spark):
    files = change_files(diff_lines(spark.createDataFrame([("p", ODD)], "patch string, text string")))
    got = {r.path: (r.old_path, r.status, r.additions, r.deletions, r.whitespace_only) for r in files.collect()}
    assert got == {
        "moved.txt": ("plain.txt", "renamed", 0, 0, False), "run.sh": (None, "modified", 0, 0, False), "déjà.txt": (None, "modified", 1, 1, False),
        "pic.png": (None, "added", 0, 0, False), "kept": ("old", "renamed", 1, 1, False), "plain/one.txt": (None, "modified", 1, 1, False),
    }
