"""Literal tables: the fixed catalogues of the engine and small example inputs.

A table is kept as SQL ``VALUES``, which Spark and the SQL oracles read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import spread_out, table

#: name -> (columns, rows as SQL)
TABLES: dict[str, tuple[str, str]] = {
    # Example schemas: type, fields as name:type:optional|required, whether the schema itself is missing
    "schemas": (
        "schema_no, name, schema_type, fields, missing",
        """(0, 'Plain', 'TypeScript', 'id:integer:required,name:string:required,mail:string:required', false),
           (1, 'Loose', 'TypeScript', 'id:number:required,name:string:required,age:integer:required,mail:string:required,note:string:optional', false),
           (2, 'ItemCreate', 'Pydantic', 'title:str:required,description:str:optional', false),
           (3, 'ItemRead', 'Pydantic', 'id:int:required,title:str:required,description:str:optional', false),
           (4, 'Item', 'OrmModel', 'id:Integer:required,title:String:required,description:Text:optional', false),
           (5, 'Anything', 'Pydantic', '', true),
           (6, 'ItemZod', 'Zod', 'id:number:required,title:string:required,discount:number:optional', false)""",
    ),
    # Constraints of fields: schema, field, kind
    "constraints": ("schema_no, field, kind", "(1, 'mail', 'Email'), (1, 'mail', 'Pattern'), (1, 'name', 'Min'), (3, 'title', 'Pattern'), (0, 'id', 'Min')"),
    # Type words and their base types (fixed values)
    "base_types": (
        "word, base_type",
        """('str', 'String'), ('string', 'String'), ('int', 'Integer'), ('integer', 'Integer'), ('number', 'Number'), ('float', 'Number'), ('double', 'Number'),
           ('bool', 'Boolean'), ('boolean', 'Boolean'), ('list', 'Array'), ('array', 'Array'), ('dict', 'Object'), ('object', 'Object'), ('null', 'Null'), ('none', 'Null')""",
    ),
    "orm_base_types": (
        "word, base_type",
        """('integer', 'Integer'), ('int', 'Integer'), ('bigint', 'Integer'), ('smallint', 'Integer'), ('string', 'String'), ('str', 'String'), ('text', 'String'), ('varchar', 'String'), ('char', 'String'),
           ('float', 'Number'), ('double', 'Number'), ('numeric', 'Number'), ('decimal', 'Number'), ('real', 'Number'), ('boolean', 'Boolean'), ('bool', 'Boolean'), ('json', 'Object'), ('jsonb', 'Object')""",
    ),
    # Transformations: the schema types they expect before and after, null for any (fixed values)
    "transformations": (
        "transformation, expects_from, expects_to",
        """('FromDict', null, 'Pydantic'), ('ValidateData', null, 'Pydantic'), ('FromJson', null, 'Pydantic'), ('ValidateJson', null, 'Pydantic'),
           ('FromOrm', 'OrmModel', 'Pydantic'), ('FromAttributes', 'OrmModel', 'Pydantic'), ('OrmToPydantic', 'OrmModel', 'Pydantic'),
           ('ToDict', 'Pydantic', null), ('ToJson', 'Pydantic', null), ('Serialize', 'Pydantic', null), ('PydanticToOrm', 'Pydantic', 'OrmModel')""",
    ),
    # Type words to try the maps on
    "type_words": (
        "word",
        """('str'), ('String'), ('int'), ('Integer'), ('number'), ('float'), ('BOOL'), ('list'), ('list[int]'), ('Optional[int]'), ('Optional[list[str]]'), ('Union[str, None]'), ('union[array, x]'), ('array'),
           ('dict'), ('dict[str, int]'), ('None'), ('datetime'), ('date'), ('uuid'), ('UUID4'), ('Text'), ('Numeric'), ('decimal'), ('jsonb'), ('json'), ('bigint'), ('object'), ('Boolean'), ('time'), (''), ('any'), ('double')""",
    ),
    # Names to try the name functions on
    "names": (
        "name",
        """('GetUsers'), ('useCreateUserMutation'), ('useGetItemByIdQuery'), ('useLazyGetItemsQuery'), ('useDeleteItemMutation'), ('useUpdateOrderMutation'), ('ItemRead'), ('ItemReadRead'), ('ItemCreateSchema'), ('Model'), ('UserResponse'),
           ('actions.users.create'), ('trpc.users.get.useQuery'), ('a.b::c'), ('x/y.ts::K::m'), ('app.get'), ('router.post'), ('api.delete.x'), ('plain'), ('items:list_items'), ('get'), (''), ('useCreateUserQuery'), ('useItemsLazyQuery'), ('createApi.useGetItemQuery'), ('ééééééééé'), ('ab日本語')""",
    ),
    "paths": ("base, path", "('users', '/profile/'), ('', ''), ('/a/', 'b'), ('/', '/'), ('x', ''), ('', 'y/z'), ('/api/v1/', '/items/{id}')"),
    # Calls in source code: file, order, called name, first argument, options, type arguments joined by a bar
    "calls": (
        "file, ord, callee, arg, options, generics, base, property",
        """('a.ts', 1, 'fetch', '/items', '{method: "POST"}', '', '', ''), ('a.ts', 2, 'fetch', '/items', '', '', '', ''), ('a.ts', 3, 'axios.get', '/x', '', 'Item', '', ''), ('a.ts', 4, 'api.post', '/y', '', '', '', ''), ('a.ts', 5, 'http.delete', '/z/1', '', '', '', ''),
           ('b.ts', 1, 'useQuery', 'gql`query`', '', 'Data|Vars', '', ''), ('b.ts', 2, 'useQuery', 'items', '', 'Item', '', ''), ('b.ts', 3, 'useMutation', 'items', '', 'Item|Error|NewItem', '', ''), ('b.ts', 4, 'useSWR', '/swr', '', 'Item', '', ''), ('b.ts', 5, 'useSWRMutation', '/swr', '', 'A|B|C|D', '', ''),
           ('c.ts', 1, 'itemsApi.useCreateItemMutation', '', '', 'Item|NewItem', '', ''), ('c.ts', 2, 'trpc.users.get.useQuery', '', '', '', '', ''), ('c.ts', 3, 'actions.users.create', '', '', '', '', ''), ('c.ts', 4, 'console.log', 'x', '', '', '', ''), ('c.ts', 5, 'api.useGetUserByIdQuery', '', '', 'User', '', ''),
           ('d.ts', 1, 'get', '{ url: "/by-base/", x: 1 }', '', '', 'client', 'get'), ('d.ts', 2, 'patch', '/plain', '', '', 'client', 'patch'), ('d.ts', 3, 'getItems', '', '', '', '', ''), ('d.ts', 4, 'addItem', '', '', '', '', ''), ('d.ts', 5, 'unknownOf', '', '', '', '', ''), ('d.ts', 6, 'createApi.useGetItemQuery', '', '', '', '', '')""",
    ),
    # Functions of generated clients: verb and path
    "sdk_calls": ("name, method, path", "('getItems', 'GET', '/items/'), ('addItem', 'POST', '/items/')"),
    # A spec's endpoints and the code's routes
    "endpoints": (
        "path, method, operation_id, response, code",
        """('/items/', 'get', 'list_items', 'ItemRead', '200'), ('/items/', 'post', 'main:create_item', 'ItemRead', '201'), ('/items/', 'post', 'main:create_item', 'Error', '422'), ('/items/{item_id}', 'get', null, 'ItemRead', 'default'),
           ('/users/', 'get', 'list_users', null, '404'), ('/users/', 'trace', 'trace_users', null, '200'), ('/dup/', 'get', 'dup', 'A', '204'), ('/dup/', 'get', 'dup', 'B', '200')""",
    ),
    "routes": ("node_id, path, method, handler, file, line", "(1, '/items/', 'GET', 'list_items', 'main.py', 44), (2, '/items/', 'POST', 'create_item', 'main.py', 52), (3, '/items', 'GET', 'list2', 'main.py', 60), (4, '/health', 'GET', 'health', 'app.py', 5), (5, '/items/', 'GET', 'again', 'app.py', 9)"),
    # Components of a spec, models and front-end types to be linked by name
    "components": ("name, field, field_type", "('Item', 'id', 'integer'), ('Item', 'title', 'string'), ('User', 'id', 'integer'), ('User', 'mail', 'string'), ('order', 'total', 'number'), ('OrderLine', 'qty', 'integer')"),
    "models": (
        "model_id, name, kind, field, field_type, optional, from_attributes",
        """(1, 'ItemRead', 'Pydantic', 'id', 'int', false, true), (1, 'ItemRead', 'Pydantic', 'title', 'str', false, true), (2, 'user', 'Pydantic', 'id', 'int', false, true), (3, 'Customer', 'Pydantic', 'id', 'int', false, true), (3, 'Customer', 'Pydantic', 'mail', 'str', false, true),
           (4, 'Order', 'Pydantic', 'total', 'float', false, true), (5, 'Unknown', 'Pydantic', 'x', 'str', true, false), (6, 'Item', 'OrmModel', 'id', 'Integer', false, true), (6, 'Item', 'OrmModel', 'title', 'Text', false, true), (7, 'Account', 'OrmModel', 'id', 'Integer', false, true), (7, 'Account', 'OrmModel', 'mail', 'String', false, true),
           (8, 'ItemCreate', 'Pydantic', 'id', 'int', false, false), (8, 'ItemCreate', 'Pydantic', 'title', 'str', false, false), (9, 'Profile', 'Pydantic', 'id', 'int', false, true), (9, 'Profile', 'Pydantic', 'mail', 'str', true, true)""",
    ),
    "zod_fields": ("field, field_type, optional", "('a', 'string', false), ('b', 'number', true), ('c', 'array', false), ('e', 'object', false), ('f', 'boolean', true)"),
    "pydantic_fields": ("field, field_type, optional", "('a', 'int', false), ('b', 'float', false), ('d', 'str', false), ('e', 'dict[str, int]', false), ('f', 'bool', true)"),
    # Front-end schema usages and the API calls of the files
    "usages": ("usage_id, schema_name, file, line", "(1, 'Item', 'a.ts', 8), (2, 'Item', 'a.ts', 10), (3, 'Item', 'a.ts', 11), (4, 'User', 'b.ts', 1), (5, 'User', 'c.ts', 3), (6, 'Item', 'a.ts', 8)"),
    "api_calls": ("call_id, file, line", "(1, 'a.ts', 10), (2, 'a.ts', 9), (3, 'a.ts', 20), (4, 'b.ts', 1), (5, 'b.ts', 4), (6, 'a.ts', 10)"),
    # A small graph with a cycle, parallel edges and a self-loop; variables and argument mappings
    "walk_edges": ("edge_id, src, dst, kind", "(0, 0, 1, 'Call'), (1, 1, 2, 'Call'), (2, 2, 0, 'Import'), (3, 1, 3, 'DataFlow'), (4, 3, 3, 'DataFlow'), (5, 3, 0, 'Call'), (6, 0, 1, 'Call'), (7, 4, 1, 'Call')"),
    "variables": ("node_id, name", "(1, 'item'), (2, 'item'), (3, 'item'), (0, 'other'), (3, 'other'), (2, 'only')"),
    "edge_args": ("edge_id, ord, param, arg", "(0, 0, 'item', 'x'), (0, 1, 'y', 'item'), (1, 0, 'item', 'item'), (3, 0, 'p', 'item'), (5, 0, 'item', 'q'), (7, 0, 'a', 'b')"),
    "functions": ("node_id, file, name", "(1, 'src/a.py', 'load'), (2, 'src/b.py', 'load'), (3, 'src/sub/c.py', 'save'), (4, 'lib/d.py', 'save'), (5, 'src/a.py', 'K::run'), (6, 'lib/e.py', 'only')"),
    "python_calls": ("call_id, file, callee", "(1, 'src/a.py', 'load'), (2, 'src/z.py', 'load'), (3, 'src/sub/x.py', 'save'), (4, 'lib/q.py', 'save'), (5, 'lib/q.py', 'run'), (6, 'src/a.py', 'missing'), (7, 'x/y.py', 'only')"),
    "imports": ("import_id, module", "(1, 'fastapi'), (2, 'fastapi.routing'), (3, 'local_module'), (4, 'os'), (5, 'pydantic_core'), (6, 'pydantic')"),
    "requirements": ("line", "('fastapi==0.111.0'), ('pydantic>=2'), ('# comment'), ('')"),
    "installed": ("module", "('pydantic')"),
    "recommendations": ("ord, severity, message", "(1, 'Critical', 'Type mismatch for field a'), (2, 'Warning', 'Missing required field b'), (3, 'Critical', 'Missing required field b'), (4, 'Warning', 'schema validation is missing'), (5, 'Warning', 'something else')"),
    # Router generators of a web framework's user module: method, path, place of request and response arguments (fixed values)
    "router_catalog": (
        "generator, ord, method, path, request_arg, response_arg",
        """('register', 1, 'POST', '/register', 1, 0), ('auth', 1, 'POST', '/login', null, null), ('auth', 2, 'POST', '/logout', null, null), ('reset', 1, 'POST', '/forgot-password', null, null), ('reset', 2, 'POST', '/reset-password', null, null),
           ('verify', 1, 'POST', '/request-verify-token', null, null), ('verify', 2, 'POST', '/verify', null, 0), ('users', 1, 'GET', '/me', null, 0), ('users', 2, 'GET', '/{id}', null, 0), ('users', 3, 'PATCH', '/{id}', 1, 0), ('users', 4, 'DELETE', '/{id}', null, null)""",
    ),
    "router_calls": ("call_id, generator, prefix, args", "(1, 'register', '/auth', 'UserRead,UserCreate'), (2, 'users', '/users', 'UserRead,UserUpdate'), (3, 'verify', '', 'UserRead'), (4, 'nothing', '/x', '')"),
    # A front-end project: files, imports, path mappings, source roots, re-exports, functions, bodies of a generated client
    "ts_files": ("file", "('web/src/app.ts'), ('web/src/api/sdk.gen.ts'), ('web/src/api/index.ts'), ('web/src/api/client.gen.ts'), ('web/src/lib/x.tsx'), ('web/src/lib/index.gen.ts'), ('web/src/shared/types.ts'), ('web/src/lib/itemQueries.ts'), ('web/src/lib/userQueries.ts'), ('web/src/itemService.ts'), ('web/src/lib/itemService.ts'), ('web/src/lib/userService.tsx'), ('web/src/api/deep.ts'), ('web/src/lib/lostQueries.ts')"),
    "ts_imports": ("import_id, file, path", "(1, 'web/src/app.ts', './api/sdk.gen'), (2, 'web/src/app.ts', './api'), (3, 'web/src/api/index.ts', '../app'), (4, 'web/src/app.ts', 'react'), (5, 'web/src/api/index.ts', './client'), (6, 'web/src/app.ts', '@/lib/x'), (7, 'web/src/lib/x.tsx', '@shared'), (8, 'web/src/app.ts', './missing'), (9, 'web/src/app.ts', '@/lib')"),
    "ts_mappings": ("ord, pattern, target", "(0, '@/*', 'src/*'), (1, '@/lib/*', 'nowhere/*'), (2, '@shared', 'src/shared/types.ts')"),
    "ts_roots": ("ord, root", "(0, 'web/src'), (1, 'web/src/lib')"),
    "ts_exports": ("file, path", "('web/src/app.ts', './api'), ('web/src/app.ts', './lib/x'), ('web/src/api/index.ts', './api/sdk.gen'), ('web/src/api/index.ts', './api/deep'), ('web/src/lib/x.tsx', './app'), ('web/src/api/deep.ts', './api')"),
    "ts_functions": (
        "file, ord, name, request, response",
        """('web/src/api/sdk.gen.ts', 1, 'getItems', null, 'Item'), ('web/src/api/sdk.gen.ts', 2, 'addItem', 'ItemNew', 'Item'), ('web/src/api/sdk.gen.ts', 3, 'getItems', null, null), ('web/src/itemService.ts', 1, 'other', 'X', 'Y'), ('web/src/itemService.ts', 2, 'api_handler', 'Item', 'Page'),
           ('web/src/lib/userService.tsx', 1, 'untyped', null, null), ('web/src/lib/userService.tsx', 2, 'load', null, 'User'), ('web/src/app.ts', 1, 'main', null, null)""",
    ),
    "sdk_functions": ("file, name, line", "('web/src/api/sdk.gen.ts', 'getItems', 2), ('web/src/api/sdk.gen.ts', 'addItem', 5), ('web/src/api/sdk.gen.ts', 'dropItem', 8), ('web/src/api/sdk.gen.ts', 'last', 12)"),
    "sdk_sources": (
        "file, content",
        """('web/src/api/sdk.gen.ts', 'import { client } from "./client"
export const getItems = (options) => {
  return (options?.client ?? client).get({ url: "/items/" })
}
export const addItem = (o) => (o.client ?? client)
  .post(client.post({ body: o,
    url: "/items/new" }))
export function dropItem() {
  client.delete(
    { Url: "/items/{id}" })
}
export const last = () => client.get()')""",
    ),
    "sdk_endpoints": ("ord, path, method, operation_id, request, response", "(0, '/first/', 'post', 'addItem', null, null), (1, '/by-spec/', 'put', 'addItem', 'ItemNew', 'Item'), (2, '/items/', 'get', 'list', null, 'ItemList'), (3, '/t/', 'trace', 'dropItem', null, null)"),
    "route_calls": ("call_id, file, line, method, path, request, response", "(1, 'web/src/app.ts', 3, 'GET', '/items/', null, 'Item'), (2, 'web/src/lib/itemQueries.ts', 4, 'PUT', '/by-spec/', 'Unused', 'Unused'), (3, 'web/src/app.ts', 9, 'POST', '/none', 'OnlyRequest', null)"),
    # Annotations, decorators, calls, parameters and classes to try the functions on
    "annotations": ("annotation", "('str'), ('Optional[str]'), ('Union[str, None]'), ('Union[int, str, None]'), ('Union[str]'), ('int | str | None'), ('list[int] | None'), ('dict[str, list[int]]'), ('List[dict[str, Any]]'), ('dict'), ('Any'), ('Page[Item]'), ('Annotated[List[int], fastapi.Query(max_length=3)]'), ('t.Annotated[Item, Body]'), ('float'), ('tuple[int, str]')"),
    "column_annotations": ("annotation", "('Mapped[int]'), ('Mapped[Optional[str]]'), ('orm.Mapped[list[Item]]'), ('Column(Integer, primary_key=True)'), ('Column(String(20), nullable=True)'), ('Integer'), ('VarString'), ('BOOLEAN'), ('Float'), ('Blob'), ('Point')"),
    "called_names": ("name", "('Item.model_validate'), ('schemas.Item.model_validate'), ('schemas.Item.parse_obj'), ('item.model_dump_json'), ('a.b.c.json'), ('Item.from_orm'), ('dict'), ('app.get'), ('router.anything'), ('x.route'), ('api.v1.post'), ('api.fetch'), ('rt.head'), ('art.get'), ('cached')"),
    "handler_parameters": ("name, annotation, is_model, decorators", "('item', 'Item', true, 'a'), ('item', 'Annotated[Item, Query()]', true, ''), ('db', 'Item', true, 'staticmethods'), ('user_in', 'Item', true, 'x.staticmethod'), ('the_session', 'Item', true, ''), ('x', 'Annotated[dict, Body(embed=True)]', false, 'y,staticmethod'), ('n', 'int', false, ''), ('users', 'Item', true, '')"),
    "class_bases": ("name, bases, annotations", "('A', 'Base', ''), ('B', 'x.declarative_base', ''), ('C', 'BaseModel', 'str'), ('D', 'BaseModel', 'str;Mapped[int]'), ('E', 'Baseline', 'Mapped[int]'), ('F', 'Other,db.Model', ''), ('G', '', '')"),
    "frontend_texts": ("text", """('Promise<Page<Item>>'), ('string'), ('Item[]'), ('any'), ('null'), ('trpc.users.get.useQuery'), ('api.add.useMutation'), ('other.x.useQuery'), ('{ url: "/a", b: 1 }'), ('{ url: ''/s'' }')"""),
    # Zod schemas, models, their usages, calls, routes and endpoints; the first is the smallest whole chain
    "zod_schemas": ("node_id, name, schema_type", "(1, 'ItemRequestZod', 'Zod'), (2, 'ItemRequest', 'Pydantic'), (3, 'Twice', 'Zod'), (4, 'Twice', 'Zod'), (5, 'Alone', 'Zod'), (6, 'Late', 'Zod'), (7, 'usermodel', 'Pydantic'), (8, 'User', 'Zod'), (9, 'UserSchema', 'Pydantic'), (10, 'Unused', 'Zod'), (11, 'Plain', 'Zod')"),
    "zod_usages": ("usage_id, schema_name, file, line", "(1, 'ItemRequestZod', 'api.ts', 8), (2, 'Twice', 'api.ts', 11), (3, 'Alone', 'none.ts', 1), (4, 'Late', 'api.ts', 90), (5, 'User', 'user.ts', 2), (6, 'User', 'api.ts', 1), (7, 'Plain', 'user.ts', 9)"),
    "zod_calls": ("call_id, file, line", "(1, 'api.ts', 10), (2, 'api.ts', 20), (3, 'user.ts', 5), (4, 'user.ts', 9), (5, 'api.ts', 30)"),
    "zod_routes": ("node_id, path, method, file, line", "(101, '/items', 'GET', 'api.ts', 10), (102, '/items', 'GET', 'api.ts', 20), (103, '/users', 'POST', 'user.ts', 5), (104, '/nowhere', 'GET', 'user.ts', 9), (105, '/other', 'GET', 'user.ts', 9)"),
    "zod_endpoints": ("path, method, request", "('/items', 'get', 'ItemRequest'), ('/users', 'post', 'User'), ('/other', 'get', 'ItemRequest')"),
    "schema_fields": ("node_id, field, field_type, optional", "(1, 'id', 'string', false), (2, 'id', 'str', false), (3, 'id', 'string', false), (3, 'n', 'number', true), (2, 'n', 'str', false), (8, 'name', 'string', false), (8, 'age', 'number', true), (7, 'name', 'str', false), (7, 'mail', 'str', false)"),
    # Schemas as the sources show them: JSON Schema text, a list of fields as JSON or text, required names, the type of an alias
    "schema_texts": (
        "schema_no, schema_type, json_schema, fields, required, type_text",
        """(-1, 'Pydantic', null, '[{"name": "a", "type_name": "Optional[int]", "optional": false, "constraints": ["Email", {"MinLength": 3}]}, {"name": "b", "type_name": "str", "optional": true, "constraints": [{"Pattern": "^x"}]}]', 'a', null),
           (-2, 'Pydantic', null, '[{"name": "a", "type_name": "str"}]', null, null), (-3, 'Pydantic', null, ' a : str , b:dict[str, int], :x, y:, c', 'a,b', null), (-4, 'Zod', null, '[{"name": "a", "type_name": "string", "optional": false, "nullable": false}]', null, null),
           (-5, 'TypeScript', null, 'a:string, b:number:optional, c, d:', null, null), (-6, 'TypeScript', null, 'a:string', null, 'string'), (-7, 'OrmModel', '{"properties": {"z": {}}}', '[{"name": "a", "type_name": "VARCHAR", "nullable": false}, {"name": "n", "type_name": "Blob", "nullable": true}]', null, null),
           (-8, 'OrmModel', null, 'a:str', null, null), (-9, 'JsonSchema', null, 'a:str', null, null), (-10, 'OpenAPI', '{"type": "object", "required": ["a", "gone", 3], "properties": {"a": {"type": "string", "pattern": "x"}, "o": {"type": ["string"]}, "p": {"type": "string", "pattern": 5}}}', null, null, null),
           (-11, 'Pydantic', '{not json', 'a:str', null, null), (-12, 'Zod', '{"required": "a", "properties": [1, 2]}', 'a:str', 'a', null), (-13, 'Pydantic', null, null, null, null), (-14, 'Pydantic', '[1]', null, null, null)""",
    ),
    # Schemas for the readable report; metadata as JSON
    "shown_schemas": ("schema_no, name, schema_type, file, line, metadata", """(1, 'User', 'Pydantic', 'app/a.py', 7, '{"json_schema": "{}", "fields": "id:int, name:str,", "b": "2", "a": "1"}'), (2, 'Object', 'JsonSchema', 'app/main.py', 9, '{"missing_schema": "true", "base_type": "Object"}'), (3, 'load', 'JsonSchema', 'b.ts', 0, '{}'),
           (4, 'Long', 'Zod', 'z.ts', 3, '{"k": "éééééééééééééééééééééééééééééééééééééééééééééééééééé"}')"""),
}


#: Rows that given tables add to the catalogues above, in SQL that Spark and the oracles' engine share; braces hold names of tables.
GROWN: dict[str, str] = {
    "python_calls": "SELECT o_orderkey + 1000, 'pkg' || (o_custkey % 7) || '/sub' || (o_custkey % 5) || '/m' || (o_custkey % 31) || '.py', 'fn' || (o_orderkey % 997) FROM {orders}",
    "functions": "SELECT p_partkey + 1000, 'pkg' || (p_partkey % 7) || '/sub' || (p_partkey % 5) || '/m' || (p_partkey % 31) || '.py', CASE WHEN p_partkey % 5 = 0 THEN 'K::' ELSE '' END || 'fn' || (p_partkey % 811) FROM {part}",
    "usages": "SELECT o_orderkey + 100, 'S' || (o_custkey % 40), 'f' || (o_custkey % 150) || '.ts', CAST(o_orderkey % 3000 AS INT) FROM {orders}",
    "api_calls": "SELECT p_partkey + 100, 'f' || (p_partkey % 150) || '.ts', CAST((p_partkey * 37) % 3000 AS INT) FROM {part}",
    "endpoints": """SELECT '/r' || (p_partkey % 700), CASE p_partkey % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'trace' END, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'mod:op' || p_partkey END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'R' || (p_partkey % 50) END,
        CASE p_partkey % 6 WHEN 1 THEN '201' WHEN 2 THEN '404' WHEN 3 THEN 'default' WHEN 4 THEN '204' ELSE '200' END FROM {part}""",
    "routes": "SELECT o_orderkey + 1000, '/r' || (o_custkey % 900), CASE o_orderkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END, 'h' || (o_orderkey % 50), 'm' || (o_custkey % 20) || '.py', CAST(o_orderkey % 400 AS INT) FROM {orders}",
    "imports": "SELECT l_orderkey * 10 + l_linenumber + 100, CASE l_partkey % 4 WHEN 0 THEN 'lib' WHEN 1 THEN 'own' ELSE 'pkg' END || (l_suppkey % 90) || CASE WHEN l_partkey % 3 = 0 THEN '.sub' ELSE '' END FROM {lineitem}",
    "requirements": "SELECT 'lib' || (s_suppkey * 2) || '>=1' FROM {supplier}",
    "installed": "SELECT 'lib' || (s_suppkey * 3) FROM {supplier}",
    "router_calls": """SELECT o_orderkey + 100, CASE o_custkey % 6 WHEN 0 THEN 'register' WHEN 1 THEN 'auth' WHEN 2 THEN 'reset' WHEN 3 THEN 'verify' WHEN 4 THEN 'users' ELSE 'other' END, '/p' || (o_custkey % 300),
        CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'M' || o_orderkey ELSE 'M' || o_orderkey || ',N' || o_custkey END FROM {orders}""",
    "models": " UNION ALL ".join(
        f"SELECT p_partkey + 1000, 'Mod' || (p_partkey % 600) || CASE WHEN p_partkey % 3 = 0 THEN 'Read' ELSE '' END, CASE WHEN p_partkey % 7 < 4 THEN 'Pydantic' ELSE 'OrmModel' END, '{f}' || (p_partkey % {n}), {t}, p_partkey % 11 = 0, p_partkey % 8 <> 2 FROM {{part}}"
        for f, n, t in (("f", 200, "'int'"), ("g", 150, "CASE WHEN p_partkey % 7 < 4 THEN 'str' ELSE 'text' END"), ("h", 120, "CASE WHEN p_partkey % 5 = 0 THEN 'bytes' ELSE 'float' END"))
    ),
    "components": "SELECT 'mod' || (s_suppkey * 3), 'f' || (s_suppkey % 200), 'integer' FROM {supplier} UNION ALL SELECT 'mod' || (s_suppkey * 3), 'g' || (s_suppkey % 150), 'string' FROM {supplier}",
    "calls": """SELECT 'u' || user_id || '.ts', event_id + 100, CASE event_id % 9 WHEN 0 THEN 'fetch' WHEN 1 THEN 'axios.post' WHEN 2 THEN 'api.get' WHEN 3 THEN 'useQuery' WHEN 4 THEN 'useMutation' WHEN 5 THEN 'op' || (event_id % 200) WHEN 6 THEN 'actions.' || event_type || '.save' WHEN 7 THEN 'api.useUpdate' || upper(event_type) || 'Mutation' ELSE event_type END,
        '/' || event_type || '/' || (event_id % 70), CASE WHEN event_id % 2 = 0 THEN '{{method: "put"}}' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN 'A|B|C' ELSE '' END, '', '' FROM {events}""",
    "sdk_calls": "SELECT 'op' || s_suppkey, 'GET', '/s/' || s_suppkey FROM {supplier}",
    "walk_edges": "SELECT c_custkey * 2 + 1000, 100 + c_custkey, 100 + CAST(floor(c_custkey / 2) AS BIGINT), 'Call' FROM {customer} UNION ALL SELECT c_custkey * 2 + 1001, 100 + c_custkey % 9, 100 + c_custkey % 31, CASE WHEN c_custkey % 2 = 0 THEN 'Import' ELSE 'DataFlow' END FROM {customer}",
    "variables": "SELECT 100 + c_custkey, 'v' || (c_custkey % 3) FROM {customer}",
    "edge_args": "SELECT c_custkey * 2 + 1000, 0, 'v' || (c_custkey % 3), 'a' || (c_custkey % 11) FROM {customer}",
    "zod_schemas": "SELECT p_partkey + 1000, 'Z' || (p_partkey % 1500), 'Zod' FROM {part} UNION ALL SELECT p_partkey + 10000000, 'z' || (p_partkey % 1200) || CASE p_partkey % 4 WHEN 0 THEN 'Schema' WHEN 1 THEN 'Model' ELSE '' END, 'Pydantic' FROM {part}",
    "zod_usages": "SELECT o_orderkey + 100, 'Z' || (o_custkey % 1500), 'f' || (o_custkey % 150) || '.ts', CAST(o_orderkey % 3000 AS INT) FROM {orders}",
    "zod_calls": "SELECT p_partkey + 100, 'f' || (p_partkey % 150) || '.ts', CAST((p_partkey * 37) % 3000 AS INT) FROM {part}",
    "zod_routes": "SELECT p_partkey + 20000000, '/r' || (p_partkey % 700), CASE WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END, 'f' || (p_partkey % 150) || '.ts', CAST((p_partkey * 37) % 3000 AS INT) FROM {part}",
    "zod_endpoints": "SELECT '/r' || (p_partkey % 700), CASE WHEN p_partkey % 2 = 0 THEN 'get' ELSE 'post' END, 'Z' || (p_partkey % 1300) FROM {part}",
    "schema_fields": """SELECT p_partkey + 1000, 'id', 'string', p_partkey % 7 = 0 FROM {part} UNION ALL SELECT p_partkey + 1000, 'q' || (p_partkey % 3), 'number', false FROM {part} UNION ALL SELECT p_partkey + 10000000, 'id', CASE WHEN p_partkey % 5 = 0 THEN 'int' ELSE 'str' END, false FROM {part}
        UNION ALL SELECT p_partkey + 10000000, 'q' || (p_partkey % 4), 'int', p_partkey % 2 = 0 FROM {part}""",
    "zod_fields": "SELECT 'f' || p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'array' ELSE 'boolean' END, p_partkey % 3 = 0 FROM {part}",
    "pydantic_fields": "SELECT 'f' || (p_partkey + 100), CASE p_partkey % 5 WHEN 0 THEN 'str' WHEN 1 THEN 'int' WHEN 2 THEN 'list[int]' WHEN 3 THEN 'bool' ELSE 'float' END, p_size % 3 = 0 FROM {part}",
    "schema_texts": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Pydantic' WHEN 1 THEN 'Zod' WHEN 2 THEN 'TypeScript' WHEN 3 THEN 'OrmModel' WHEN 4 THEN 'OpenAPI' ELSE 'JsonSchema' END,
        CASE WHEN p_partkey % 6 >= 4 OR p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 17 = 0 THEN '{{"properties": ' || p_name ELSE '{{"type": "object", "required": ["id"' || CASE WHEN p_size % 2 = 0 THEN ', "size"' ELSE '' END || '], "properties": {{"id": {{"type": "integer", "minimum": ' || p_size || '}}, "name": {{"type": "string", "pattern": "^' || p_brand || '"}}, "'
            || CASE WHEN p_size % 3 = 0 THEN 'size' ELSE 'price' END || '": {{"type": "' || CASE WHEN p_size % 5 = 0 THEN 'string' ELSE 'number' END || '"}}}}}}' END END,
        CASE p_partkey % 6 WHEN 0 THEN '[{{"name": "id", "type_name": "' || CASE WHEN p_size % 4 = 0 THEN 'str' ELSE 'int' END || '", "optional": false, "constraints": []}}, {{"name": "name", "type_name": "str", "optional": true, "constraints": [' || CASE WHEN p_size % 3 = 0 THEN '{{"Pattern": "^a"}}' WHEN p_size % 3 = 1 THEN '"Email"' ELSE '' END || ']}}]'
            WHEN 1 THEN '[{{"name": "id", "type_name": "number", "optional": false, "nullable": false}}, {{"name": "name", "type_name": "string", "optional": true, "nullable": true}}]' WHEN 2 THEN 'id:number,name:string:optional,size:' || CASE WHEN p_size % 2 = 0 THEN 'string' ELSE 'number' END
            WHEN 3 THEN '[{{"name": "id", "type_name": "Integer", "nullable": false}}, {{"name": "size", "type_name": "' || CASE WHEN p_size % 2 = 0 THEN 'Text' ELSE 'Numeric' END || '", "nullable": true}}]' ELSE 'id:int,name:str' END,
        CASE WHEN p_partkey % 4 = 0 THEN 'id, name' ELSE NULL END, CASE WHEN p_partkey % 29 = 0 THEN 'string' ELSE NULL END FROM {part}""",
    # A front-end project with a page of queries, a client and mostly a service for each customer
    "ts_files": """SELECT 'web/src/lib/c' || c_custkey || 'Queries.ts' FROM {customer} UNION ALL SELECT 'web/src/api/c' || c_custkey || '.gen.ts' FROM {customer}
        UNION ALL SELECT 'web/src/c' || c_custkey || 'Service.ts' FROM {customer} WHERE c_custkey % 3 = 0 UNION ALL SELECT 'web/src/lib/c' || c_custkey || 'Service.tsx' FROM {customer} WHERE c_custkey % 4 = 0
        UNION ALL SELECT 'web/src/lib/c' || c_custkey || 'Service.ts' FROM {customer} WHERE c_custkey % 5 = 0""",
    "ts_imports": """SELECT o_orderkey + 100, 'web/src/lib/c' || o_custkey || 'Queries.ts', CASE o_orderkey % 5 WHEN 0 THEN './c' || o_custkey || 'Service' WHEN 1 THEN '@/lib/c' || o_custkey || 'Service' WHEN 2 THEN 'react'
        WHEN 3 THEN '../c' || o_custkey || 'Service' ELSE '@/api/c' || o_custkey || '.gen' END FROM {orders}""",
    "ts_exports": """SELECT 'web/src/lib/c' || c_custkey || 'Queries.ts', '../api/c' || c_custkey || '.gen' FROM {customer}
        UNION ALL SELECT 'web/src/lib/c' || c_custkey || 'Queries.ts', './c' || (c_custkey + 1) || 'Queries' FROM {customer} WHERE c_custkey % 4 <> 0""",
    "ts_functions": """SELECT 'web/src/' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'lib/' END || 'c' || c_custkey || CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'Service.ts' ELSE 'Service.tsx' END, CAST(10 + 2 * (c_custkey % 7) AS INT), 'load',
        CASE WHEN c_custkey % 2 = 0 THEN 'In' || (c_custkey % 40) END, CASE WHEN c_custkey % 7 <> 0 THEN 'Out' || c_custkey END FROM {customer}
        UNION ALL SELECT 'web/src/' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'lib/' END || 'c' || c_custkey || CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'Service.ts' ELSE 'Service.tsx' END, 15,
        CASE WHEN c_custkey % 4 = 1 THEN 'api_handler' ELSE 'load' END, NULL, 'H' || c_custkey FROM {customer} UNION ALL SELECT 'web/src/api/c' || c_custkey || '.gen.ts', 1, 'call' || c_custkey, NULL, NULL FROM {customer}""",
    "sdk_functions": """SELECT 'web/src/api/c' || c_custkey || '.gen.ts', 'call' || c_custkey, 2 FROM {customer} UNION ALL SELECT 'web/src/api/c' || c_custkey || '.gen.ts', 'spread' || c_custkey, 3 FROM {customer}
        UNION ALL SELECT 'web/src/api/c' || c_custkey || '.gen.ts', 'lost' || c_custkey, 6 FROM {customer}""",
    "sdk_sources": """SELECT 'web/src/api/c' || c_custkey || '.gen.ts', '// client' || chr(10) || 'export const call = () => client.' || CASE WHEN c_custkey % 2 = 0 THEN 'get' ELSE 'post' END || '({{ url: "/s/' || c_custkey || '" }})' || chr(10)
        || 'export const spread = (o) =>' || chr(10) || '  client.delete(' || chr(10) || '    {{ url: "/d/' || c_custkey || '" }})' || chr(10) || 'export const lost = () => 1' FROM {customer}""",
    "sdk_endpoints": """SELECT p_partkey + 10, '/p/' || (p_partkey % 700), CASE p_partkey % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'trace' END, CASE WHEN p_partkey % 4 <> 0 THEN 'call' || (p_partkey % 400) END,
        CASE WHEN p_partkey % 5 = 0 THEN 'Rq' || p_partkey END, 'Rs' || p_partkey FROM {part}""",
    "route_calls": """SELECT o_orderkey + 10, 'web/src/lib/c' || o_custkey || 'Queries.ts', CAST(o_orderkey % 90 AS INT), CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END, '/p/' || (o_orderkey % 900),
        CASE WHEN o_orderkey % 3 = 0 THEN 'A' || o_custkey END, CASE WHEN o_orderkey % 7 <> 0 THEN 'B' || o_custkey END FROM {orders}""",
    "names": """SELECT CASE p_partkey % 6 WHEN 0 THEN 'useGetM' || p_partkey || 'Query' WHEN 1 THEN 'useUpdateUserM' || p_partkey || 'Mutation' WHEN 2 THEN 'M' || p_partkey || 'ReadResponse' WHEN 3 THEN 'router.' || CASE WHEN p_size % 2 = 0 THEN 'post' ELSE 'get' END || '.x' || p_partkey
        WHEN 4 THEN 'app/m' || (p_partkey % 9) || '.py::fn' || p_partkey ELSE 'actions.user.m' || p_partkey END FROM {part}""",
    "recommendations": """SELECT l_orderkey * 10 + l_linenumber + 100, CASE WHEN l_linenumber = 1 THEN 'Critical' ELSE 'Warning' END, CASE l_partkey % 4 WHEN 0 THEN 'Type mismatch for field f' WHEN 1 THEN 'Missing required field f' WHEN 2 THEN 'Add schema validation to f'
        ELSE 'Look at f' END || (l_partkey % 500) FROM {lineitem}""",
    "annotations": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'Optional[M' || p_partkey || ']' WHEN 1 THEN 'list[M' || p_partkey || '] | None' WHEN 2 THEN 'Page[M' || p_partkey || ']' ELSE 'Annotated[M' || p_partkey || ', Body]' END FROM {part}",
    "column_annotations": "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Mapped[Optional[M' || p_partkey || ']]' WHEN 1 THEN 'orm.Mapped[list[M' || p_partkey || ']]' ELSE 'Column(String(' || (p_size + 100) || '), nullable=True)' END FROM {part}",
    "called_names": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'schemas.M' || p_partkey || '.model_validate' WHEN 1 THEN 'm' || p_partkey || '.model_dump_json' WHEN 2 THEN 'router.r' || p_partkey ELSE 'fn' || p_partkey END FROM {part}",
    "handler_parameters": "SELECT 'p' || p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Annotated[M, Query()]' ELSE 'M' || p_partkey END, p_partkey % 2 = 0, CASE p_partkey % 3 WHEN 0 THEN 'x,staticmethod' WHEN 1 THEN 'staticmethods' ELSE '' END FROM {part}",
    "class_bases": "SELECT 'K' || p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Base' WHEN 1 THEN 'BaseModel' WHEN 2 THEN 'Mixin,db.Model' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'str;int' ELSE '' END FROM {part}",
    "frontend_texts": """SELECT CASE p_partkey % 4 WHEN 0 THEN 'Promise<Page<M' || p_partkey || '>>' WHEN 1 THEN 'M' || p_partkey || '[]' WHEN 2 THEN 'trpc.u' || p_partkey || '.get.useQuery' ELSE '{{ url: "/' || p_partkey || '", b: 1 }}' END FROM {part}""",
    "paths": "SELECT '/' || p_brand || '/', p_type || '/' || p_name FROM {part}",
}


def values(name: str) -> str:
    """The catalogue as a table of a query, with the rows that given tables add."""
    columns, rows = TABLES[name]
    if name not in GROWN:
        return f"(VALUES {rows}) AS {name}({columns})"
    more = re.sub(r"\{(\w+)\}", r"\1", GROWN[name]).replace("{{", "{").replace("}}", "}")
    return f"(SELECT * FROM (VALUES {rows}) AS {name}({columns}) UNION ALL {more}) AS {name}({columns})"


def rows_added(name: str) -> str:
    """What given tables add to the catalogue, as a table of an oracle."""
    more = re.sub(r"\{(\w+)\}", r"\1", GROWN[name]).replace("{{", "{").replace("}}", "}")
    columns, rows = TABLES[name]
    return f"(SELECT * FROM (VALUES {rows}) AS {name}({columns}) WHERE false UNION ALL {more}) AS {name}({columns})"


def literal(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = TABLES[name]
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS {name}({columns})")


def grown(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The catalogue with the rows that given tables add."""
    text = GROWN[name]
    used = {t: table(spark, sf_dir, t) for t in set(re.findall(r"(?<!\{)\{(\w+)\}", text))}
    return literal(spark, name).union(spark.sql(text, **used))


def ctes(*names: str) -> str:
    """WITH clause that defines these tables in an oracle."""
    return "WITH " + ", ".join(f"{n} AS (SELECT * FROM {values(n)})" for n in names)


def per_supplier(spark: SparkSession, sf_dir: str, texts: dict[str, str], *words: str) -> DataFrame:
    """(path, content): the texts, and once more for each supplier below a folder of its own, with the supplier's number behind these words."""
    rows = F.inline(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in texts.items())))
    every = spread_out(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))).select("key", rows)
    content = F.col("content")
    for word in words:
        content = F.replace(content, F.lit(word), F.concat(F.lit(word), "key"))
    return spark.createDataFrame(list(texts.items()), "path string, content string").unionByName(every.select(F.concat(F.lit("team"), "key", F.lit("/"), "path").alias("path"), content.alias("content")))


def per_supplier_sql(sql: str, words: tuple[str, ...], texts: tuple[str, ...] = (), paths: tuple[str, ...] = ()) -> str:
    """The oracle of a query over ``per_supplier``: the rows of ``sql``, and for each supplier with the number behind the words and the folder before the paths."""
    changed = []
    for column in texts:
        text = column
        for word in words:
            text = f"replace({text}, '{word}', '{word}' || s_suppkey)"
        changed.append(f"{text} AS {column}")
    changed += [f"'team' || s_suppkey || '/' || {column} AS {column}" for column in paths]
    return f"WITH x AS ({sql}) SELECT * FROM x UNION ALL SELECT x.* REPLACE ({', '.join(changed)}) FROM x CROSS JOIN supplier"
