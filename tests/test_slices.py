import random

from pyspark.sql import functions as F

from corpusloom.operators import slices
from tests.helpers import corpus


def cut(spark, text, ranges):
    values = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ranges])
    return spark.createDataFrame([(text,)], "t string").select(F.split("t", "\n", -1).alias("lines")).select(
        slices.slice_lines(F.col("lines"), values)).first()[0]


def plain(text, ranges):
    lines = text.split("\n")
    keep = [any(a <= i <= b for a, b in ranges) for i in range(len(lines))]
    out, missing = [], 0
    for line, kept in zip(lines, keep):
        if kept:
            if missing:
                out.append(f"// ... [{missing} lines omitted] ...")
            missing = 0
            out.append(line)
        else:
            missing += 1
    if missing:
        out.append(f"// ... [{missing} lines omitted] ...")
    return "\n".join(out)


def test_slices_equal_the_plain_rule(spark):
    rng = random.Random(5)
    for _ in range(12):
        text = "\n".join(f"line {i}" for i in range(rng.randint(1, 25)))
        ranges = [(a, a + rng.randint(0, 8)) for a in (rng.randint(0, 27) for _ in range(rng.randint(1, 5)))]
        assert cut(spark, text, ranges) == plain(text, ranges)


SOURCE = '''import { X } from './x';
import {
  Y,
} from "./y";

const before = { a: "{" }; // }

/* class Hidden {
   {{{ */
@Injectable()
@Scope({
  a: { b: 1 }
})
export class Auth extends Base {
  private x = '}';

  constructor(private a: A) {
    super();
  }

  @Get('login')
  async login(user: string) {
    if (user) {
      return `}`;
    }
  }

  logout() { return 1; }
}

export default async function helper(a) {
  return a;
}

function login() { return 2; }
'''


def spans(spark):
    rows = slices.declarations(slices.code_lines(corpus(spark, {"a.ts": SOURCE}))).collect()
    return {(r.kind, r.class_name, r.name, r.start, r.end) for r in rows}


def test_declarations(spark):
    assert spans(spark) == {
        ("import", "", "", 0, 0), ("import", "", "", 1, 3),
        ("class", "Auth", "", 9, 28), ("method", "Auth", "login", 20, 25), ("method", "Auth", "logout", 27, 27),
        ("function", "", "helper", 30, 32), ("function", "", "login", 34, 34)}


def sliced(spark, *symbols):
    rows = slices.slice_symbols(corpus(spark, {"a.ts": SOURCE}), symbols).collect()
    return rows[0].sliced if rows else None


def test_symbols(spark):
    lines = SOURCE.split("\n")
    assert sliced(spark, "Auth.login") == plain(SOURCE, [(0, 0), (1, 3), (20, 25)])
    assert sliced(spark, "Auth") == plain(SOURCE, [(0, 3), (9, 28)])
    # A class and its own method: the union, counted once.
    assert sliced(spark, "Auth", "Auth.logout") == sliced(spark, "Auth")
    # Functions are compared by the part before the dot.
    assert sliced(spark, "helper.anything") == plain(SOURCE, [(0, 3), (30, 32)])
    assert sliced(spark, "Nothing", "Auth.none") is None
    assert "\n".join(lines[20:26]) in sliced(spark, "Auth.login")


def test_braces_in_patterns_templates_and_accessors(spark):
    source = """import { X } from './x';
const r = /[{]/, half = 4 / 2, s = 'it\\'s {';
const page = `
  <b>{{{ ${half}
`;
export class Shop {
  get open() { return /}/g.test('}'); }
  sell(a) {
    return a.replace(/\\/[/{]+/, "{"); // }
  }
}
"""
    files = corpus(spark, {"a.ts": source})
    found = {(r.kind, r.class_name, r.name, r.start, r.end) for r in slices.declarations(slices.code_lines(files)).collect()}
    assert found == {("import", "", "", 0, 0), ("class", "Shop", "", 5, 10), ("method", "Shop", "sell", 7, 9)}


def test_hidden_parts_keep_their_lines(spark):
    source = "a /* { \n } */ b // {\n`x\n{` + '{' / \"}\"\nlet q = `${'"
    code = corpus(spark, {"a.ts": source}).select(slices.code_only(F.col("content").cast("string"))).first()[0]
    assert code == 'a \n b \n""\n + "" / ""\nlet q = ${'
