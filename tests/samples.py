"""Small Python sources of many kinds: classes, closures, loops, handlers, matches, comprehensions, text beyond ASCII."""

from __future__ import annotations

SOURCES = [
    "import math\n\n\ndef area(r):\n    if r < 0:\n        raise ValueError('radius')\n    else:\n        return math.pi * r ** 2\n",
    "def count(words):\n    seen = {}\n    for w in words:\n        if w in seen:\n            seen[w] += 1\n        else:\n            seen[w] = 1\n    return seen\n",
    "class Stack:\n    def __init__(self):\n        self.items = []\n\n    def push(self, x):\n        self.items.append(x)\n        return self\n\n    def pop(self):\n        if not self.items:\n            return None\n        else:\n            return self.items.pop()\n",
    "def outer(n):\n    total = 0\n\n    def inner(k):\n        return k * n\n    for k in range(n):\n        total += inner(k)\n    return total\n",
    "def read(path):\n    try:\n        with open(path) as f:\n            return f.read()\n    except OSError as e:\n        print('é', e)\n        return ''\n    finally:\n        print('done')\n",
    "def kind(x):\n    match x:\n        case 0:\n            return 'zero'\n        case [a, *rest]:\n            return a\n        case _:\n            return None\n",
    "def gcd(a, b):\n    while b:\n        a, b = b, a % b\n    return a\n\n\nprint(gcd(12, 18))\n",
    "def grade(n):\n    if n > 90:\n        g = 'a'\n    elif n > 70:\n        g = 'b'\n    elif n > 50:\n        g = 'c'\n    else:\n        g = 'd'\n    return g\n",
    "evens = [x for x in range(20) if x % 2 == 0]\nsquares = {x: x * x for x in evens}\nif len(squares) > 5:\n    print('many')\nelse:\n    print('few')\n",
    "@staticmethod\ndef clamp(x, low=0, high=1):\n    # keep within\n    if (\n        x < low\n    ):\n        return low\n    else:\n        return min(x, high)\n",
    "async def gather(tasks):\n    out = []\n    async for t in tasks:\n        out.append(await t)\n    return out\n",
    "def collatz(n):\n    steps = 0\n    while n != 1:\n        if n % 2 == 0:\n            n //= 2\n        else:\n            n = 3 * n + 1\n        steps += 1\n    return steps\n",
]
