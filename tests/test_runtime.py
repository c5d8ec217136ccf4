from packloom import runtime


def test_a_worker_keeps_one_owner_at_a_time():
    runtime._kept.clear()
    a = runtime.keep_only("a", list)
    assert runtime.keep_only("a", list) is a and runtime.keep_only("a") is a
    assert runtime.keep_only("b") is None and runtime._kept == {}
    b = runtime.keep_only("b", dict)
    assert runtime._kept == {"b": b} and runtime.keep_only("a", list) is not a
    runtime._kept.clear()
