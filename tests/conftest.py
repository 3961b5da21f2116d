import pytest

from repograph.session import clear_run, local_session


@pytest.fixture(scope="session")
def spark():
    # Test tables are tiny, so compiling code would take longer than running the plans.
    spark = local_session(
        4, spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN",
        spark__sql__shuffle__partitions="2")
    yield spark
    clear_run(spark)
