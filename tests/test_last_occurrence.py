from shoebox import plans
from tests.conftest import SMALL


def test_every_order_has_its_last_line(spark, duck):
    got = [r.id for r in plans.QUERIES["last_occurrence"](spark, SMALL).collect()]
    assert sorted(got) == [i for (i,) in duck.execute("SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1").fetchall()]
