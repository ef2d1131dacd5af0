from riskloom.llm import common


def test_a_worker_holds_the_stores_of_one_operator():
    held = lambda: sorted(common._PROCESS)
    common._PROCESS.clear()
    one = common.per_process("sums left", "a", dict)
    common.per_process("sums right", "a", dict)
    assert common.per_process("sums left", "a", dict) is one and held() == ["sums left", "sums right"]
    assert common.per_process("sums left", "b", dict) is not one and held() == ["sums left", "sums right"]
    common.per_process("counts", "a", dict)
    assert held() == ["counts"]
    common._PROCESS.clear()
