"""python -m tidegate.cli: queries, uploads and reports as one line of JSON; exit code 2 on refusal."""

from __future__ import annotations

import argparse
import json
import sys
from typing import NoReturn

from tidegate.errors import RequestError, TidegateError
from tidegate.session import session


def _strategy(spark, args) -> dict:
    from tidegate.model import CombinatorialCV
    from tidegate.operators import strategy
    from tidegate.plans.benchmarks import strategy_report
    from tidegate.sources.arrays import demo_panel, read_panel

    candidates = strategy.grid()
    rows = demo_panel(spark) if args.data == "demo" else read_panel(spark, args.data)
    strategy.require_dense(rows)
    found = strategy.tracks(strategy.weights(rows, candidates, strategy.Execution()), [args.cost]).cache()
    try:
        return strategy_report(found, 252.0, 8, CombinatorialCV(6, 2), 252, 4, len(candidates))
    finally:
        found.unpersist()


def _query(spark, args) -> dict:
    from tidegate.catalogue import queries

    if args.name not in queries():
        raise RequestError("no such query")
    found = [json.loads(r) for r in queries()[args.name](spark, args.data).limit(args.rows + 1).toJSON().collect()]
    return {"rows": found[: args.rows], "more_rows": len(found) > args.rows}


def _forward(spark, args) -> dict:
    from tidegate.operators.forward import ForwardProtocol
    from tidegate.sources.forward_store import PREDICTION, SETTLEMENT, ForwardStore, fields

    try:
        with open(args.protocol, encoding="utf-8") as given:
            protocol = ForwardProtocol(**json.load(given))
    except (OSError, TypeError, ValueError) as error:
        raise RequestError(f"the protocol cannot be read: {type(error).__name__}") from error
    store = ForwardStore(spark, args.store)
    found = {}
    if args.action == "init":
        found["protocol_digest"] = store.register(protocol)
    elif args.action in ("record", "settle"):
        if not args.batch:
            raise RequestError(f"{args.action} needs --batch")
        reader = spark.read.schema(fields(PREDICTION if args.action == "record" else SETTLEMENT))
        batch = reader.parquet(args.batch) if args.batch.endswith(".parquet") else reader.option("mode", "FAILFAST").json(args.batch)
        found["rows"] = (store.record if args.action == "record" else store.settle)(protocol, batch).count()
    return {**found, "report": store.report(protocol).first().asDict()}


def _request(spark, args) -> dict:
    from tidegate import runs

    return runs.run(spark, runs.read_request(args.request))


def _upload(spark, args) -> dict:
    from tidegate import runs

    options = {k: v for k, v in vars(args).items() if v is not None and k not in ("run", "action", "data", "manifest", "mapping", "seconds")}
    document = {"schema_version": "1", "action": args.action, "data_path": args.data, "manifest_path": args.manifest, "mapping_path": args.mapping, "options": options, "timeout_seconds": args.seconds}
    return runs.run(spark, runs.checked(document))


def _schema(_, args) -> dict:
    from tidegate import runs

    return {"schema": runs.schema(args.kind)}


def _example(_, args) -> dict:
    from tidegate import runs

    return {"files": runs.export(runs.example(args.name), args.output_dir)}


class JsonParser(argparse.ArgumentParser):
    """Refuses arguments as it refuses anything else: by one line of JSON and exit code 2."""

    def error(self, message: str) -> NoReturn:
        print(json.dumps({"status": "error", "error": "RequestError", "message": "the arguments are invalid"}, sort_keys=True))
        raise SystemExit(2)


def _upload_parsers(actions) -> None:
    from tidegate.runs import ACTIONS, CEILINGS, SECONDS, EvaluationPlan

    for action in ACTIONS:
        parser = actions.add_parser(action, help=f"{action} an upload of one data file, its manifest and its mapping")
        for name in ("data", "manifest", "mapping"):
            parser.add_argument(f"--{name}", required=True)
        parser.add_argument("--seconds", type=int, default=SECONDS)
        for name in CEILINGS:
            parser.add_argument(f"--{name.replace('_', '-')}", type=int)
        if action == "evaluate":
            for name, value in vars(EvaluationPlan()).items():
                parser.add_argument(f"--{name.replace('_', '-')}", type=type(value))
        parser.set_defaults(run=_upload, action=action)


def main(argv: list[str] | None = None) -> int:
    parser = JsonParser(prog="tidegate")
    actions = parser.add_subparsers(required=True, parser_class=JsonParser)
    _upload_parsers(actions)
    request = actions.add_parser("run", help="a request in a JSON file: audit or evaluate, with limits and a time limit")
    request.add_argument("--request", required=True)
    request.set_defaults(run=_request)
    schema = actions.add_parser("schema", help="the JSON schema of a document")
    schema.add_argument("--kind", choices=["request", "manifest", "mapping"], required=True)
    schema.set_defaults(run=_schema, local=True)
    example = actions.add_parser("example", help="the files of a small upload, in a new folder")
    example.add_argument("--name", choices=["level", "change", "leak"], required=True)
    example.add_argument("--output-dir", required=True)
    example.set_defaults(run=_example, local=True)
    strategy = actions.add_parser("strategy", help="momentum candidates on an .npz panel, or on 'demo'")
    strategy.add_argument("data")
    strategy.add_argument("--cost", type=float, default=0.0)
    strategy.set_defaults(run=_strategy)
    query = actions.add_parser("query", help="a registered query on a folder of tables")
    query.add_argument("name")
    query.add_argument("data")
    query.add_argument("--rows", type=int, default=100, help="rows to print; more_rows says whether there are others")
    query.set_defaults(run=_query)
    forward = actions.add_parser("forward", help="a forward ledger in a folder")
    forward.add_argument("action", choices=["init", "record", "settle", "status"])
    forward.add_argument("--protocol", required=True, help="a JSON file with the fields of ForwardProtocol")
    forward.add_argument("--store", required=True)
    forward.add_argument("--batch", help="predictions or settlements, as Parquet or lines of JSON")
    forward.set_defaults(run=_forward)
    args = parser.parse_args(argv)
    try:
        found = {"status": "ok", **args.run(None if hasattr(args, "local") else session(), args)}
    except TidegateError as error:
        found = {"status": "error", "error": type(error).__name__, "message": str(error)}
    print(json.dumps(found, sort_keys=True, default=str))
    return 0 if found["status"] == "ok" else 2


if __name__ == "__main__":
    sys.exit(main())
