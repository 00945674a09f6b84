"""A second generated corpus: one file per supplier, in one of four languages by
key, whose code holds the forms that the customer corpus lacks (decorators,
from-imports, several bases, TypeScript attributes, arrow functions, getters,
structs, templates, enums, mixins, extensions, exports, named constructors,
arrow bodies, variables over several lines, values over 80 characters, name
clashes, a class of the same name in every file, non-ASCII names).

``%s`` in a template stands for the supplier's key, ``%n`` for its nation's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "9" * 100
TEMPLATES = {
    "py": '''from lib_%n import alpha as a, beta
import side_%s, other.part
from . import near

NAMES_%s = [1, 'two', -3]
LEFT_%s, right_%s = 1, 2
WIDE_%s: int = ''' + LONG + '''


def lead_%s(a, b=1, /, c=-2, *, d, e=alpha(3), **kw) -> int:
    """Leads  the
    file."""
    return outer(inner_%s(a))(b)


class Shared(Base%n, mix.Part):
    kind: str = "x"
    size = (1, 2)

    def __init__(self, año, *rest):
        self.año = año
        if rest:
            self.tail_%s = [1]
        self.kind = "y"

    @property
    def title(self):
        return self.año.title().strip()

    @staticmethod
    @cached(size=%s)
    async def fetch_%s(url, n: int = 2):
        await get_%s(url)
''',
    "ts": '''import def_%s from 'dlib_%n';
import * as all from "alib";
import { one, two as deux } from './near';
import 'side_%s';

export const arrow_%s = async (x) => {
  deep_%s(x);
};
const LONG_%s: string = ''' + LONG + ''';
let lead_%s = 1;

export function lead_%s(a = { k: f(g(h(i(1)))) }) {
  body_%s();
}

export default class Shared extends Base%n {
  private readonly rate_%s: number = %s;
  static count: string;
  plain_%s = 5;
  constructor(a) {
    this.late_%s = make(a);
  }
  get size_%s() {
    return this.calc();
  }
  static async run_%s(a) {
    await go_%s(a);
  }
}
''',
    "cpp": '''#include <vector>
#include "part_%n.h"
#define WIDE_%s ''' + LONG + '''

static const int SEP_%s = 1'000;

template <typename T> struct Shared : Base%n {
  int width = %s;
  static T* next_%s;
  explicit Shared(int x) {
    init_%s(x);
  }
  const int area_%s(int a) const {
    return std::max(a, side(a));
  }
};

enum class Tone_%s : int { LOW, HIGH };

inline int lead_%s(int a) {
  return Shared(a) + ns_%s::go(a);
}
''',
    "dart": '''import 'lib_%n.dart' show one, two;
import 'other.dart' as o;
export 'part_%s.dart';

final List<int> names_%s = [
  %s,
  2,
];

enum Tone_%s { low, high }

mixin Mix_%s on Base%n {
  int mixed = 1;
}

extension Ext_%s on String {
  int twice_%s() => length_%s(2);
}

class Shared extends Base%n with Mix_%s implements Face {
  final int rate = %s;
  Shared.named_%s(int x) {
    setUp(x);
  }
  Widget draw_%s(ctx) =>
      Row(children: [
        Cell(1),
      ]);
}

Future<int> lead_%s(int x) async {
  return work_%s(x);
}
''',
}


def feature_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, path, content)``; two repositories, by the key's remainder by 8."""
    s = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select("s_suppkey", "s_nationkey")
    kinds = list(TEMPLATES)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    text = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        text = F.when(F.col("s_suppkey") % 4 == i, F.lit(TEMPLATES[k])).otherwise(text)
    text = F.replace(F.replace(text, F.lit("%s"), F.col("s_suppkey").cast("string")), F.lit("%n"), F.col("s_nationkey").cast("string"))
    return s.select(F.when(F.col("s_suppkey") % 8 < 4, "left").otherwise("right").alias("repo"),
                    F.concat(F.lit("feat/f_"), F.col("s_suppkey"), F.lit("."), kind).alias("path"), text.alias("content"))
