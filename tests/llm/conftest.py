from tests.conftest import spark, tmpdir_fresh  # noqa: F401
