"""Controllers of the decorator framework: decorators by their targets, sources of parameters, transfer objects, types of requests and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import frontend
from linkweave.operators.linking import first_by
from linkweave.plans.fixtures import per_supplier, per_supplier_sql
from linkweave.session import table
from linkweave.sources import typescript_source

TARGETS = ("class_decorator", "method_decorator", "param_decorator")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"]+|['\"]+$", "")


def decorators_by_target(facts: DataFrame) -> DataFrame:
    """(path, target, owner, decorators): names in order for classes and methods, the last one for a parameter."""
    found = facts.filter(F.col("fact").isin(*TARGETS)).groupBy("path", F.col("fact").alias("target"), "owner").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("d"))
    all_names = F.transform("d", lambda x: x["name"])
    return found.select("path", "target", "owner", F.array_join(F.when(F.col("target") == "param_decorator", F.slice(all_names, -1, 1)).otherwise(all_names), ",").alias("decorators"))


def parameter_sources(facts: DataFrame) -> DataFrame:
    """(path, handler, parameter, source, key): where a parameter comes from, by its last decorator; the key of a path parameter is the decorator's text, else its name."""
    last = first_by(facts.filter("fact = 'param_decorator'"), ["path", "owner"], [F.desc("ord")])
    parameter, handler = F.element_at(F.split("owner", r"\."), -1), F.regexp_extract("owner", r"^(.*)\.[^.]*$", 1)
    source = F.when(F.col("name").isin("Query", "Param", "Headers"), F.col("name")).otherwise("Body")
    return last.select("path", handler.alias("handler"), parameter.alias("parameter"), source.alias("source"), F.when(source == "Param", F.coalesce(_bare(F.get("args", 0)), parameter)).alias("key"))


def validated_properties(facts: DataFrame, fact: str = "field_decorator") -> DataFrame:
    """(path, class, property, validation, optional) of the properties of classes with validating decorators.

    The analysed tool looks at decorators of parameters (``fact`` param_decorator), where no such name can stand, and so finds no class; here properties count."""
    found = facts.filter(F.col("fact") == fact).withColumns({"class": F.split_part("owner", F.lit("."), F.lit(1)), "property": F.element_at(F.split("owner", r"\."), -1)})
    classes = found.filter(F.col("name").isin(*frontend.VALIDATORS)).select("path", "class").distinct()
    each = found.join(classes, ["path", "class"], "left_semi").groupBy("path", "class", "property").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("d"))
    all_names = F.transform("d", lambda x: x["name"])
    return each.select("path", "class", "property", F.array_join(all_names, ",").alias("validation"), F.array_contains(all_names, "IsOptional").alias("optional"))


def transfer_objects(facts: DataFrame, fact: str = "field_decorator") -> DataFrame:
    """(path, class, line) of the classes that ``validated_properties`` finds."""
    classes = validated_properties(facts, fact).select("path", "class").distinct()
    return facts.filter("fact = 'class'").select("path", F.col("name").alias("class"), "line").join(classes, ["path", "class"])


def method_nodes(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (class, method) with the first method of that class and name: path, ord."""
    methods = facts.filter("fact = 'method'").select("path", "ord", F.element_at(F.split("owner", r"\."), -1).alias("class"), F.col("name").alias("method"))
    return asked.join(first_by(methods, ["class", "method"], ["path", "ord"]), ["class", "method"])


def handler_types(facts: DataFrame) -> DataFrame:
    """(path, handler, body, position, request, dto, response) of methods: the parameter that the first Body decorator stands at with its place and type, whether
    that type is a transfer object, and the result's type without its Promise."""
    body = first_by(facts.filter("fact = 'param_decorator' and name = 'Body'"), ["path", "owner"], ["ord"]).withColumn("handler", F.regexp_extract("owner", r"^(.*)\.[^.]*$", 1))
    body = first_by(body, ["path", "handler"], ["ord"]).select("path", "handler", F.element_at(F.split("owner", r"\."), -1).alias("body"))
    methods = facts.filter("fact = 'method'").select("path", F.concat_ws(".", "owner", "name").alias("handler"), "detail", "args")
    parameters = F.transform("args", lambda a: F.struct(F.split_part(a, F.lit(":"), F.lit(1)).alias("name"), F.nullif(F.regexp_extract(a, "(?s)^[^:]*:(.*)$", 1), F.lit("")).alias("type")))
    j = methods.withColumn("p", parameters).join(body, ["path", "handler"], "left").withColumn("position", (F.array_position(F.transform("p", lambda x: x["name"]), F.col("body")) - 1).cast("int"))
    j = j.withColumn("position", F.when(F.col("position") >= 0, F.col("position"))).withColumn("request", F.get("p", F.col("position"))["type"])
    dtos = transfer_objects(facts).select(F.col("class").alias("request"), F.lit(True).alias("dto")).distinct()
    response = F.nullif(F.regexp_replace("detail", r"(?s)^Promise<(.*)>$", "$1"), F.lit(""))
    return j.join(dtos, "request", "left").select("path", "handler", "body", "position", "request", F.coalesce("dto", F.lit(False)).alias("dto"), response.alias("response"))


EXAMPLE = {
    "cats.controller.ts": """import { Controller, Get, Post, Body, Param, Query } from '@nestjs/common';

export class CatDto {
  @IsString() @Length(1, 9) name: string;
  @IsOptional() @IsNumber() age?: number;
}
export class Plain {
  @Column() name: string;
}
@Controller('cats')
@UseGuards(Auth)
export class CatsController {
  @Post('new') @HttpCode(201)
  create(@Query() q: string, @Body() cat: CatDto): Promise<Cat> { return this.cats.create(cat); }
  @Get(':id')
  one(@Param('id') id: string, @Headers() h: Map, @Param() other: string): Cat { return this.cats.one(id); }
  @Post()
  raw(@Body() any: Plain) {}
}
""",
}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the example, and of a team's controllers for each supplier."""
    return typescript_source.extract(per_supplier(spark, sf_dir, EXAMPLE, "Cat", "Plain"))


def _asked_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT 'CatsController' AS class, 'one' AS method UNION ALL SELECT 'Cat' || s_suppkey || 'sController', 'one' FROM {supplier}", supplier=table(spark, sf_dir, "supplier"))


QUERIES = {
    "nest_decorators": lambda s, d: decorators_by_target(_facts(s, d)).select("target", "owner", "decorators"),
    "nest_parameter_sources": lambda s, d: parameter_sources(_facts(s, d)).select("handler", "parameter", "source", "key"),
    "nest_transfer_objects": lambda s, d: validated_properties(_facts(s, d)).select("class", "property", "validation", "optional"),
    "nest_transfer_classes": lambda s, d: transfer_objects(_facts(s, d)).select("class", "line"),
    "nest_method_nodes": lambda s, d: method_nodes(_facts(s, d), _asked_methods(s, d)).select("class", "method", "path"),
    "nest_handler_types": lambda s, d: handler_types(_facts(s, d)).select("handler", "body", "position", "request", "dto", "response"),
}
ORACLE_SQL = {
    "nest_decorators": per_supplier_sql("SELECT * FROM (VALUES ('class_decorator', 'CatsController', 'Controller,UseGuards'), ('method_decorator', 'CatsController.create', 'Post,HttpCode'), ('method_decorator', 'CatsController.one', 'Get'), ('method_decorator', 'CatsController.raw', 'Post'), ('param_decorator', 'CatsController.create.q', 'Query'), ('param_decorator', 'CatsController.create.cat', 'Body'), ('param_decorator', 'CatsController.one.id', 'Param'), ('param_decorator', 'CatsController.one.h', 'Headers'), ('param_decorator', 'CatsController.one.other', 'Param'), ('param_decorator', 'CatsController.raw.any', 'Body')) AS t(target, owner, decorators)", ('Cat', 'Plain'), ('owner',), ()),
    "nest_parameter_sources": per_supplier_sql("SELECT * FROM (VALUES ('CatsController.create', 'q', 'Query', NULL), ('CatsController.create', 'cat', 'Body', NULL), ('CatsController.one', 'id', 'Param', 'id'), ('CatsController.one', 'h', 'Headers', NULL), ('CatsController.one', 'other', 'Param', 'other'), ('CatsController.raw', 'any', 'Body', NULL)) AS t(handler, parameter, source, key)", ('Cat', 'Plain'), ('handler',), ()),
    "nest_transfer_objects": per_supplier_sql("SELECT * FROM (VALUES ('CatDto', 'name', 'IsString,Length', false), ('CatDto', 'age', 'IsOptional,IsNumber', true)) AS t(class, property, validation, optional)", ('Cat', 'Plain'), ('class',), ()),
    "nest_transfer_classes": per_supplier_sql("SELECT 'CatDto' AS class, 3 AS line", ('Cat', 'Plain'), ('class',), ()),
    "nest_method_nodes": per_supplier_sql("SELECT 'CatsController' AS class, 'one' AS method, 'cats.controller.ts' AS path", ('Cat', 'Plain'), ('class',), ('path',)),
    "nest_handler_types": per_supplier_sql("SELECT * FROM (VALUES ('CatsController.create', 'cat', 1, 'CatDto', true, 'Cat'), ('CatsController.one', NULL, NULL, NULL, false, 'Cat'), ('CatsController.raw', 'any', 0, 'Plain', false, NULL)) AS t(handler, body, position, request, dto, response)", ('Cat', 'Plain'), ('handler', 'request', 'response'), ()),
}
