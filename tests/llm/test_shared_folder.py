"""The text queries where Spark's configuration is empty."""

from tests.test_shared_folder import run


def test_text_queries_without_a_checkpoint_folder(tmp_path):
    done = run(tmp_path, "text")
    assert done.stdout.strip().endswith("whole"), done.stderr[-3000:]
