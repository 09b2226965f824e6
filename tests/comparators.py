"""Importable comparators: executors unpickle them by name."""


def by_last_digit_then_down(a, b):
    x, y = (a[0] % 10, -a[0]), (b[0] % 10, -b[0])
    return (x > y) - (x < y)
