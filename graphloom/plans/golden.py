"""Expected rows of the extraction and adapter queries, checked by hand against the sample repository (fixed values)."""

EXPECTED = {
    "ext1_typescript": [
        ('backend/routes.ts', 'module', 'routes', None, 1, None, ''),
        ('backend/routes.ts', 'variable', 'BASE', 'backend.routes', 1, None, ''),
        ('ng/routes.ts', 'class', 'HomeComponent', 'ng.routes', 3, None, 'end_line=3'),
        ('ng/routes.ts', 'module', 'routes', None, 1, None, ''),
        ('ng/routes.ts', 'variable', 'routes', 'ng.routes', 1, None, ''),
        ('old/app.js', 'module', 'app', None, 1, None, ''),
        ('web/CartPage.tsx', 'call', 'get', None, 3, None, 'starts=web.CartPage.api;steps=get(1)'),
        ('web/CartPage.tsx', 'call', 'navigate', None, 3, None, 'starts=web.CartPage.navigate;steps=(1)'),
        ('web/CartPage.tsx', 'function', 'CartPage', 'web.CartPage', 3, None, 'params=0'),
        ('web/CartPage.tsx', 'imports', './cart.css', None, 1, './cart.css', 'modules=web.cart.css web.cart.css.index'),
        ('web/CartPage.tsx', 'module', 'CartPage', None, 1, None, ''),
        ('web/calls.ts', 'module', 'calls', None, 1, None, ''),
        ('web/grpc.ts', 'module', 'grpc', None, 1, None, ''),
        ('web/model.ts', 'class', 'Model', 'web.model', 2, None, 'end_line=3'),
        ('web/model.ts', 'function', 'open', 'web.model', 4, None, 'params=1'),
        ('web/model.ts', 'imports', './other', None, 1, './other', 'modules=web.other web.other.index'),
        ('web/model.ts', 'inherits', 'Store', None, 2, 'Store', 'starts=web.model.Store'),
        ('web/model.ts', 'module', 'model', None, 1, None, ''),
    ],
    "ext2_csharp": [
        ('bill/Client.cs', 'module', 'Client', None, 1, None, ''),
        ('bill/Grpc.cs', 'module', 'Grpc', None, 1, None, ''),
        ('bill/Invoice.cs', 'class', 'Invoice', 'Bill', 3, None, 'end_line=6'),
        ('bill/Invoice.cs', 'implements', 'IPrintable', None, 3, 'IPrintable', 'starts=Bill.Invoice.IPrintable Bill.IPrintable bill.Invoice.IPrintable System.IPrintable'),
        ('bill/Invoice.cs', 'imports', 'System', None, 1, 'System', ''),
        ('bill/Invoice.cs', 'inherits', 'Document', None, 3, 'Document', 'starts=Bill.Invoice.Document Bill.Document bill.Invoice.Document System.Document'),
        ('bill/Invoice.cs', 'method', 'Print', 'Bill.Invoice', 5, None, 'params=0;signature=()'),
        ('bill/Invoice.cs', 'module', 'Invoice', None, 1, None, ''),
        ('bill/Invoice.cs', 'namespace', 'Bill', 'bill.Invoice', 2, None, ''),
        ('bill/OrdersController.cs', 'class', 'OrdersController', 'bill.OrdersController', 2, None, 'end_line=5'),
        ('bill/OrdersController.cs', 'method', 'Get', 'bill.OrdersController.OrdersController', 4, None, 'params=1;signature=(int)'),
        ('bill/OrdersController.cs', 'module', 'OrdersController', None, 1, None, ''),
    ],
    "ext3_java": [
        ('mail/Kafka.java', 'call', 'send', None, 4, None, 'starts=self;steps=kafkaTemplate send(2);types=mail.Kafka.Stream'),
        ('mail/Kafka.java', 'class', 'Stream', 'mail.Kafka', 1, None, 'end_line=5'),
        ('mail/Kafka.java', 'method', 'on', 'mail.Kafka.Stream', 3, None, 'params=1;signature=(BillEvent)'),
        ('mail/Kafka.java', 'method', 'send', 'mail.Kafka.Stream', 4, None, 'params=0;signature=()'),
        ('mail/Kafka.java', 'module', 'Kafka', None, 1, None, ''),
        ('mail/Rabbit.java', 'call', 'convertAndSend', None, 4, None, 'starts=self;steps=rabbitTemplate convertAndSend(2);types=mail.Rabbit.Listener'),
        ('mail/Rabbit.java', 'class', 'Listener', 'mail.Rabbit', 1, None, 'end_line=5'),
        ('mail/Rabbit.java', 'method', 'on', 'mail.Rabbit.Listener', 3, None, 'params=1;signature=(OrderEvent)'),
        ('mail/Rabbit.java', 'method', 'send', 'mail.Rabbit.Listener', 4, None, 'params=0;signature=()'),
        ('mail/Rabbit.java', 'module', 'Rabbit', None, 1, None, ''),
        ('shop/src/Cart.java', 'class', 'Cart', 'shop', 3, None, 'end_line=6'),
        ('shop/src/Cart.java', 'implements', 'Closeable', None, 3, 'Closeable', 'starts=shop.Cart.Closeable shop.Closeable'),
        ('shop/src/Cart.java', 'imports', 'java.util.List', None, 2, 'java.util.List', ''),
        ('shop/src/Cart.java', 'inherits', 'Base', None, 3, 'Base', 'starts=shop.Cart.Base shop.Base'),
        ('shop/src/Cart.java', 'method', 'add', 'shop.Cart', 4, None, 'params=1;signature=(int)'),
        ('shop/src/Cart.java', 'module', 'Cart', None, 1, None, ''),
        ('shop/src/Cart.java', 'namespace', 'shop', 'shop.src.Cart', 1, None, ''),
        ('shop/src/CartController.java', 'class', 'CartController', 'shop.src.CartController', 2, None, 'end_line=5'),
        ('shop/src/CartController.java', 'method', 'all', 'shop.src.CartController.CartController', 4, None, 'params=0;signature=();type=shop.src.CartController.CartController.List shop.src.CartController.List'),
        ('shop/src/CartController.java', 'module', 'CartController', None, 1, None, ''),
        ('shop/src/Feign.java', 'interface', 'Stock', 'shop.src.Feign', 2, None, 'end_line=5'),
        ('shop/src/Feign.java', 'method', 'items', 'shop.src.Feign.Stock', 4, None, 'params=0;signature=();type=shop.src.Feign.Stock.String shop.src.Feign.String'),
        ('shop/src/Feign.java', 'module', 'Feign', None, 1, None, ''),
        ('shop/src/Grpc.java', 'call', 'get', None, 1, None, 'starts=self;steps=s get(1);types=shop.src.Grpc.G'),
        ('shop/src/Grpc.java', 'call', 'newBlockingStub', None, 1, None, 'starts=shop.src.Grpc.G.OrdersGrpc shop.src.Grpc.OrdersGrpc;steps=newBlockingStub(1);types=shop.src.Grpc.G'),
        ('shop/src/Grpc.java', 'class', 'G', 'shop.src.Grpc', 1, None, 'end_line=1'),
        ('shop/src/Grpc.java', 'method', 'f', 'shop.src.Grpc.G', 1, None, 'params=0;signature=()'),
        ('shop/src/Grpc.java', 'module', 'Grpc', None, 1, None, ''),
    ],
    "ext4_python": [
        ('stock/client.py', 'imports', 'httpx', None, 1, 'httpx', ''),
        ('stock/client.py', 'module', 'client', None, 1, None, ''),
        ('stock/client.py', 'variable', 'c', 'stock.client', 2, None, ''),
        ('stock/grpc.py', 'module', 'grpc', None, 1, None, ''),
        ('stock/grpc.py', 'variable', 's', 'stock.grpc', 1, None, ''),
        ('stock/views.py', 'function', 'items', 'stock.views', 3, None, 'end_line=4'),
        ('stock/views.py', 'module', 'views', None, 1, None, ''),
        ('stock/views.py', 'variable', 'router', 'stock.views', 1, None, ''),
        ('stock/views.py', 'variable', 'urlpatterns', 'stock.views', 5, None, ''),
        ('tools/base.py', 'class', 'Reader', 'tools.base', 1, None, 'end_line=3'),
        ('tools/base.py', 'function', 'close', 'tools.base.Reader', 2, None, 'end_line=3'),
        ('tools/base.py', 'module', 'base', None, 1, None, ''),
        ('tools/load.py', 'class', 'Loader', 'tools.load', 4, None, 'end_line=6'),
        ('tools/load.py', 'function', 'run', 'tools.load.Loader', 5, None, 'end_line=6'),
        ('tools/load.py', 'imports', 'base', None, 2, 'tools.base', ''),
        ('tools/load.py', 'imports', 'os', None, 1, 'os', ''),
        ('tools/load.py', 'inherits', 'Reader', None, 4, 'Reader', ''),
        ('tools/load.py', 'module', 'load', None, 1, None, ''),
        ('tools/load.py', 'variable', 'LIMIT', 'tools.load', 3, None, ''),
    ],
    "ext5_cpp": [
        ('native/grid.cpp', 'class', 'Grid', 'native.grid', 3, None, ''),
        ('native/grid.cpp', 'function', 'area', 'native.grid', 5, None, ''),
        ('native/grid.cpp', 'imports', 'grid.h', None, 2, 'grid.h', 'system=false'),
        ('native/grid.cpp', 'imports', 'vector', None, 1, 'vector', 'system=true'),
        ('native/grid.cpp', 'module', 'grid', None, 1, None, ''),
    ],
    "ext6_compose": [
        ('docker-compose.yml', 'depends_on', 'api', None, None, 'db', ''),
        ('docker-compose.yml', 'infrastructure', 'db', None, None, None, 'image=postgres:16;kind=database'),
        ('docker-compose.yml', 'service', 'api', None, None, None, 'image=acme/api'),
        ('docker-compose.yml', 'service', 'db', None, None, None, 'image=postgres:16'),
    ],
    "ext7_appsettings": [
        ('api/appsettings.json', 'binding', 'Bus', None, None, 'mq', 'engine=rabbitmq;type=broker;value=amqp://***:***@mq:5672'),
        ('api/appsettings.json', 'binding', 'ConnectionStrings__Main', None, None, 'db1', 'engine=postgresql;type=database;value=Host=db1;Password=***;Provider=Npgsql'),
    ],
    "ext8_openapi": [
        ('api/openapi.yaml', 'endpoint', 'GET /carts', 'Shop API', None, '/carts', 'method=GET;operation_id=list'),
        ('api/openapi.yaml', 'endpoint', 'POST /carts', 'Shop API', None, '/carts', 'method=POST'),
        ('api/openapi.yaml', 'spec', 'Shop API', None, None, None, ''),
    ],
    "ext9_dotnet_project": [
        ('bill/Bill.csproj', 'package', 'Polly', 'Bill.csproj', 1, None, ''),
        ('bill/Bill.csproj', 'project', 'Bill.csproj', None, 1, 'bill/Bill.csproj', 'type=web'),
        ('bill/Bill.csproj', 'project_reference', 'Core.csproj', 'Bill.csproj', 1, 'core/Core.csproj', ''),
        ('core/Core.csproj', 'project', 'Core.csproj', None, 1, 'core/Core.csproj', 'type=classlib'),
    ],
    "ext10_maven": [
        ('shop/pom.xml', 'module', 'shop', 'root', 1, 'shop', 'boot=true;group=g;packaging=jar'),
    ],
    "ext11_gradle": [
        ('mail/build.gradle', 'module', 'mail', None, 1, 'mail', 'boot=true;group=g;packaging=jar'),
    ],
    "ext12_spring_config": [
        ('shop/application.yml', 'datasource', 'datasource', None, None, 'pg', 'engine=postgresql'),
        ('shop/application.yml', 'port', '8081', None, None, None, ''),
    ],
    "ext13_bus_rabbit": [
        ('mail/Rabbit.java', 'handler', 'Listener', 'Listener', 4, 'mails', 'role=producer'),
        ('mail/Rabbit.java', 'handler', 'OrderEvent', 'Listener', 2, 'orders', 'method=on;role=consumer'),
    ],
    "ext14_bus_kafka": [
        ('mail/Kafka.java', 'handler', 'BillEvent', 'Stream', 2, 'bills', 'method=on;role=consumer'),
        ('mail/Kafka.java', 'handler', 'Stream', 'Stream', 4, 'acks', 'role=producer'),
    ],
    "ext15_ts_api_routes": [
        ('backend/routes.ts', 'route', 'GET /carts', None, 2, '/carts', 'complete=true;method=GET'),
        ('backend/routes.ts', 'route', 'POST /v1/carts', None, 3, '/v1/carts', 'complete=true;method=POST'),
    ],
    "ext16_dotnet_api_routes": [
        ('bill/OrdersController.cs', 'route', 'GET /api/Orders/{id}', 'Get', 3, '/api/Orders/{id}', 'method=GET'),
    ],
    "ext17_java_api_routes": [
        ('shop/src/CartController.java', 'route', 'GET /api/carts', 'all', 3, '/api/carts', 'method=GET'),
        ('shop/src/Feign.java', 'route', 'GET /stock/items', 'items', 3, '/stock/items', 'method=GET'),
    ],
    "ext18_python_api_routes": [
        ('stock/client.py', 'python_file', 'stock/client.py', None, 1, None, ''),
        ('stock/grpc.py', 'python_file', 'stock/grpc.py', None, 1, None, ''),
        ('stock/views.py', 'include', 'stock.more', None, 5, 'stock.more', ''),
        ('stock/views.py', 'python_file', 'stock/views.py', None, 1, None, ''),
        ('stock/views.py', 'route', 'GET /stock/items', 'items', 3, '/stock/items', 'method=GET'),
        ('stock/views.py', 'url_pattern', 'more/', None, 5, 'stock.more', 'regex=false'),
        ('stock/views.py', 'url_pattern', 'old/', 'legacy', 5, None, 'regex=false'),
        ('tools/base.py', 'python_file', 'tools/base.py', None, 1, None, ''),
        ('tools/load.py', 'python_file', 'tools/load.py', None, 1, None, ''),
    ],
    "ext19_ts_http_calls": [
        ('old/app.js', 'http_call', 'GET /api/start', None, 3, '/api/start', 'client=client;method=GET'),
        ('web/CartPage.tsx', 'http_call', 'GET /carts', None, 3, '/carts', 'client=client;method=GET'),
        ('web/calls.ts', 'http_call', 'GET /carts/:id', None, 1, '/carts/:id', 'client=client;method=GET'),
        ('web/calls.ts', 'http_call', 'POST /orders', None, 2, '/orders', 'client=fetch;method=POST'),
    ],
    "ext20_dotnet_http_calls": [
        ('bill/Client.cs', 'http_call', 'GET /rates', None, 1, '/rates', 'callee=backend;client=httpclient;method=GET'),
    ],
    "ext21_java_http_calls": [
        ('shop/src/Feign.java', 'http_call', 'GET /stock/items', None, 3, '/stock/items', 'callee=stock;client=feign;method=GET'),
    ],
    "ext22_python_http_calls": [
        ('stock/client.py', 'http_call', 'GET http://rates.example/today', None, 3, 'http://rates.example/today', 'client=c;method=GET'),
    ],
    "ext23_grpc_proto": [
        ('proto/orders.proto', 'grpc_method', 'Get', 'Orders', 3, None, 'client_streaming=false;server_streaming=true'),
        ('proto/orders.proto', 'grpc_method', 'Put', 'Orders', 4, None, 'client_streaming=true;server_streaming=false'),
        ('proto/orders.proto', 'grpc_service', 'Orders', 'orders', 2, None, ''),
    ],
    "ext24_ts_grpc_calls": [
        ('web/grpc.ts', 'grpc_call', 'OrderService/getOrder', None, 1, 'grpc-proto:grpc_method:OrderService/getOrder', 'method=getOrder;service=OrderService'),
    ],
    "ext25_java_grpc_calls": [
        ('shop/src/Grpc.java', 'grpc_call', 'Orders/get', None, 1, 'grpc-proto:grpc_method:Orders/get', 'method=get;service=Orders'),
    ],
    "ext26_dotnet_grpc_calls": [
        ('bill/Grpc.cs', 'grpc_call', 'Orders/Get', None, 2, 'grpc-proto:grpc_method:Orders/Get', 'method=Get;service=Orders'),
    ],
    "ext27_python_grpc_calls": [
        ('stock/grpc.py', 'grpc_call', 'Orders/Get', None, 2, 'grpc-proto:grpc_method:Orders/Get', 'method=Get;service=Orders'),
    ],
    "ext28_react_ui": [
        ('backend/routes.ts', 'ui_file', 'backend/routes.ts', None, 1, None, ''),
        ('backend/routes.ts', 'ui_function', None, None, 1, None, ''),
        ('backend/routes.ts', 'ui_router', 'backend/routes.ts', None, 1, None, 'named=true'),
        ('ng/routes.ts', 'ui_file', 'ng/routes.ts', None, 1, None, ''),
        ('ng/routes.ts', 'ui_function', None, None, 1, None, ''),
        ('ng/routes.ts', 'ui_route', '/home', None, 1, 'HomeComponent', ''),
        ('ng/routes.ts', 'ui_router', 'ng/routes.ts', None, 1, None, 'named=true'),
        ('old/app.js', 'ui_file', 'old/app.js', None, 1, None, ''),
        ('old/app.js', 'ui_function', None, None, 1, None, ''),
        ('web/CartPage.tsx', 'ui_control', 'buy', None, 3, 'buy', 'kind=button'),
        ('web/CartPage.tsx', 'ui_file', 'web/CartPage.tsx', None, 1, None, ''),
        ('web/CartPage.tsx', 'ui_function', 'CartPage', None, 3, None, ''),
        ('web/CartPage.tsx', 'ui_function', None, None, 1, None, ''),
        ('web/CartPage.tsx', 'ui_navigation', '/cart', None, 1, None, 'via=navigate'),
        ('web/CartPage.tsx', 'ui_route', '/cart', None, 2, 'CartPage', ''),
        ('web/CartPage.tsx', 'ui_router', 'web/CartPage.tsx', None, 1, None, 'named=false'),
        ('web/CartPage.tsx', 'ui_style', './cart.css', None, 1, 'web/cart.css', 'kind=global_css'),
        ('web/calls.ts', 'ui_call', 'POST', None, 2, '/orders', ''),
        ('web/calls.ts', 'ui_file', 'web/calls.ts', None, 1, None, ''),
        ('web/calls.ts', 'ui_function', None, None, 1, None, ''),
        ('web/grpc.ts', 'ui_file', 'web/grpc.ts', None, 1, None, ''),
        ('web/grpc.ts', 'ui_function', None, None, 1, None, ''),
        ('web/model.ts', 'ui_file', 'web/model.ts', None, 1, None, ''),
        ('web/model.ts', 'ui_function', None, None, 1, None, ''),
        ('web/model.ts', 'ui_function', 'open', None, 4, None, ''),
        ('web/model.ts', 'ui_import', 'x', None, 1, 'web/other', 'exported=x'),
        ('web/package.json', 'ui_file', 'web/package.json', None, 1, None, ''),
        ('web/package.json', 'ui_package', 'web', None, 1, 'web', ''),
    ],
    "ext29_angular_ui": [
        ('ng/routes.ts', 'ui_component', 'HomeComponent', None, 2, 'app-home', ''),
        ('ng/routes.ts', 'ui_route', 'home', None, 1, 'HomeComponent', ''),
    ],
    "ext30_angularjs_ui": [
        ('old/app.js', 'invokes_api', 'GET /api/start', None, 3, '/api/start', 'method=GET'),
        ('old/app.js', 'ui_module', 'old', None, 1, None, ''),
        ('old/app.js', 'ui_route', '/start', None, 2, 'start', 'state=start;url=/start'),
    ],
    "ext31_spa_roots": [
        ('web/package.json', 'spa', 'web', None, 1, 'web', 'framework=react'),
    ],
    "adp1_symbols": [
        ('edge', 'python:imports:python:tools/load.py:module:tools.load->python:tools/base.py:module:tools.base', 'imports', 'python:tools/load.py:module:tools.load', 'python:tools/base.py:module:tools.base'),
        ('edge', 'python:inherits:python:tools/load.py:class:tools.load.Loader->python:tools/base.py:class:tools.base.Reader', 'inherits', 'python:tools/load.py:class:tools.load.Loader', 'python:tools/base.py:class:tools.base.Reader'),
        ('node', 'python:stock/client.py:module:stock.client', 'module', None, None),
        ('node', 'python:stock/client.py:variable:stock.client.c', 'variable', 'python:stock/client.py:module:stock.client', None),
        ('node', 'python:stock/grpc.py:module:stock.grpc', 'module', None, None),
        ('node', 'python:stock/grpc.py:variable:stock.grpc.s', 'variable', 'python:stock/grpc.py:module:stock.grpc', None),
        ('node', 'python:stock/views.py:function:stock.views.items', 'function', 'python:stock/views.py:module:stock.views', None),
        ('node', 'python:stock/views.py:module:stock.views', 'module', None, None),
        ('node', 'python:stock/views.py:variable:stock.views.router', 'variable', 'python:stock/views.py:module:stock.views', None),
        ('node', 'python:stock/views.py:variable:stock.views.urlpatterns', 'variable', 'python:stock/views.py:module:stock.views', None),
        ('node', 'python:tools/base.py:class:tools.base.Reader', 'class', 'python:tools/base.py:module:tools.base', None),
        ('node', 'python:tools/base.py:function:tools.base.Reader.close', 'function', 'python:tools/base.py:class:tools.base.Reader', None),
        ('node', 'python:tools/base.py:module:tools.base', 'module', None, None),
        ('node', 'python:tools/load.py:class:tools.load.Loader', 'class', 'python:tools/load.py:module:tools.load', None),
        ('node', 'python:tools/load.py:function:tools.load.Loader.run', 'function', 'python:tools/load.py:class:tools.load.Loader', None),
        ('node', 'python:tools/load.py:module:tools.load', 'module', None, None),
        ('node', 'python:tools/load.py:variable:tools.load.LIMIT', 'variable', 'python:tools/load.py:module:tools.load', None),
    ],
    "adp2_compose": [
        ('edge', 'compose:connects_to:compose:service:docker-compose.yml#api->compose:database:docker-compose.yml#db', 'connects_to', 'compose:service:docker-compose.yml#api', 'compose:database:docker-compose.yml#db'),
        ('edge', 'compose:depends_on:compose:service:docker-compose.yml#api->compose:service:docker-compose.yml#db', 'depends_on', 'compose:service:docker-compose.yml#api', 'compose:service:docker-compose.yml#db'),
        ('node', 'compose:database:docker-compose.yml#db', 'database', None, None),
        ('node', 'compose:service:docker-compose.yml#api', 'service', None, None),
        ('node', 'compose:service:docker-compose.yml#db', 'service', None, None),
    ],
    "adp3_appsettings": [
        ('edge', 'appsettings:connects_to:compose:service:docker-compose.yml#api->appsettings:broker:rabbitmq:mq', 'connects_to', 'compose:service:docker-compose.yml#api', 'appsettings:broker:rabbitmq:mq'),
        ('edge', 'appsettings:connects_to:compose:service:docker-compose.yml#api->appsettings:database:postgresql:db1', 'connects_to', 'compose:service:docker-compose.yml#api', 'appsettings:database:postgresql:db1'),
        ('node', 'appsettings:broker:rabbitmq:mq', 'broker', None, None),
        ('node', 'appsettings:database:postgresql:db1', 'database', None, None),
    ],
    "adp4_openapi": [
        ('edge', 'openapi:documents:openapi:external_api:api/openapi.yaml->openapi:http_endpoint:docker-compose.yml#api|GET|/carts', 'documents', 'openapi:external_api:api/openapi.yaml', 'openapi:http_endpoint:docker-compose.yml#api|GET|/carts'),
        ('edge', 'openapi:documents:openapi:external_api:api/openapi.yaml->openapi:http_endpoint:docker-compose.yml#api|POST|/carts', 'documents', 'openapi:external_api:api/openapi.yaml', 'openapi:http_endpoint:docker-compose.yml#api|POST|/carts'),
        ('edge', 'openapi:exposes:compose:service:docker-compose.yml#api->openapi:http_endpoint:docker-compose.yml#api|GET|/carts', 'exposes', 'compose:service:docker-compose.yml#api', 'openapi:http_endpoint:docker-compose.yml#api|GET|/carts'),
        ('edge', 'openapi:exposes:compose:service:docker-compose.yml#api->openapi:http_endpoint:docker-compose.yml#api|POST|/carts', 'exposes', 'compose:service:docker-compose.yml#api', 'openapi:http_endpoint:docker-compose.yml#api|POST|/carts'),
        ('node', 'openapi:external_api:api/openapi.yaml', 'external_api', None, None),
        ('node', 'openapi:http_endpoint:docker-compose.yml#api|GET|/carts', 'http_endpoint', 'compose:service:docker-compose.yml#api', None),
        ('node', 'openapi:http_endpoint:docker-compose.yml#api|POST|/carts', 'http_endpoint', 'compose:service:docker-compose.yml#api', None),
    ],
    "adp5_dotnet_project": [
        ('edge', 'dotnet-project:project_reference:dotnet-project:dotnet_project:bill/Bill.csproj->dotnet-project:dotnet_project:core/Core.csproj', 'project_reference', 'dotnet-project:dotnet_project:bill/Bill.csproj', 'dotnet-project:dotnet_project:core/Core.csproj'),
        ('node', 'dotnet-project:dotnet_project:bill/Bill.csproj', 'dotnet_project', None, None),
        ('node', 'dotnet-project:dotnet_project:core/Core.csproj', 'dotnet_project', None, None),
    ],
    "adp6_maven": [
        ('node', 'compose:service:docker-compose.yml#shop', 'service', None, None),
    ],
    "adp6_gradle": [
        ('node', 'compose:service:docker-compose.yml#mail', 'service', None, None),
    ],
    "adp7_spring_config": [
        ('edge', 'spring-config:connects_to:compose:service:docker-compose.yml#shop->spring-config:database:postgresql:pg', 'connects_to', 'compose:service:docker-compose.yml#shop', 'spring-config:database:postgresql:pg'),
        ('node', 'compose:service:docker-compose.yml#shop', 'service', None, None),
        ('node', 'spring-config:database:postgresql:pg', 'database', None, None),
    ],
    "adp8_bus_rabbit": [
        ('edge', 'bus-rabbit:consumes:compose:service:docker-compose.yml#mail->bus-rabbit:message_topic:orders', 'consumes', 'compose:service:docker-compose.yml#mail', 'bus-rabbit:message_topic:orders'),
        ('edge', 'bus-rabbit:publishes:compose:service:docker-compose.yml#mail->bus-rabbit:message_topic:mails', 'publishes', 'compose:service:docker-compose.yml#mail', 'bus-rabbit:message_topic:mails'),
        ('edge', 'bus-rabbit:rpc_handles:compose:service:docker-compose.yml#mail->bus-rabbit:message_type:OrderEvent', 'rpc_handles', 'compose:service:docker-compose.yml#mail', 'bus-rabbit:message_type:OrderEvent'),
        ('node', 'bus-rabbit:message_topic:mails', 'message_topic', None, None),
        ('node', 'bus-rabbit:message_topic:orders', 'message_topic', None, None),
        ('node', 'bus-rabbit:message_type:Listener', 'message_type', None, None),
        ('node', 'bus-rabbit:message_type:OrderEvent', 'message_type', None, None),
    ],
    "adp9_bus_kafka": [
        ('edge', 'bus-kafka:consumes:compose:service:docker-compose.yml#mail->bus-kafka:message_topic:bills', 'consumes', 'compose:service:docker-compose.yml#mail', 'bus-kafka:message_topic:bills'),
        ('edge', 'bus-kafka:publishes:compose:service:docker-compose.yml#mail->bus-kafka:message_topic:acks', 'publishes', 'compose:service:docker-compose.yml#mail', 'bus-kafka:message_topic:acks'),
        ('edge', 'bus-kafka:rpc_handles:compose:service:docker-compose.yml#mail->bus-kafka:message_type:BillEvent', 'rpc_handles', 'compose:service:docker-compose.yml#mail', 'bus-kafka:message_type:BillEvent'),
        ('node', 'bus-kafka:message_topic:acks', 'message_topic', None, None),
        ('node', 'bus-kafka:message_topic:bills', 'message_topic', None, None),
        ('node', 'bus-kafka:message_type:BillEvent', 'message_type', None, None),
        ('node', 'bus-kafka:message_type:Stream', 'message_type', None, None),
    ],
    "adp10_ts_routes": [
        ('edge', 'ts-api-routes:exposes:compose:service:docker-compose.yml#backend->ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts', 'exposes', 'compose:service:docker-compose.yml#backend', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts'),
        ('edge', 'ts-api-routes:exposes:compose:service:docker-compose.yml#backend->ts-api-routes:http_endpoint:docker-compose.yml#backend|POST|/v1/carts', 'exposes', 'compose:service:docker-compose.yml#backend', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|POST|/v1/carts'),
        ('node', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts', 'http_endpoint', 'compose:service:docker-compose.yml#backend', None),
        ('node', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|POST|/v1/carts', 'http_endpoint', 'compose:service:docker-compose.yml#backend', None),
    ],
    "adp10_java_routes": [
        ('edge', 'java-api-routes:exposes:compose:service:docker-compose.yml#shop->java-api-routes:http_endpoint:docker-compose.yml#shop|GET|/api/carts', 'exposes', 'compose:service:docker-compose.yml#shop', 'java-api-routes:http_endpoint:docker-compose.yml#shop|GET|/api/carts'),
        ('edge', 'java-api-routes:exposes:compose:service:docker-compose.yml#shop->java-api-routes:http_endpoint:docker-compose.yml#shop|GET|/stock/items', 'exposes', 'compose:service:docker-compose.yml#shop', 'java-api-routes:http_endpoint:docker-compose.yml#shop|GET|/stock/items'),
        ('node', 'java-api-routes:http_endpoint:docker-compose.yml#shop|GET|/api/carts', 'http_endpoint', 'compose:service:docker-compose.yml#shop', None),
        ('node', 'java-api-routes:http_endpoint:docker-compose.yml#shop|GET|/stock/items', 'http_endpoint', 'compose:service:docker-compose.yml#shop', None),
    ],
    "adp11_ts_http_calls": [
        ('edge', 'ts-http-calls:http_calls:compose:service:docker-compose.yml#old->ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/api/start|old/app.js:3', 'http_calls', 'compose:service:docker-compose.yml#old', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/api/start'),
        ('edge', 'ts-http-calls:http_calls:compose:service:docker-compose.yml#web->ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts/:id|web/calls.ts:1', 'http_calls', 'compose:service:docker-compose.yml#web', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts/:id'),
        ('edge', 'ts-http-calls:http_calls:compose:service:docker-compose.yml#web->ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts|web/CartPage.tsx:3', 'http_calls', 'compose:service:docker-compose.yml#web', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/carts'),
        ('edge', 'ts-http-calls:http_calls:compose:service:docker-compose.yml#web->ts-api-routes:http_endpoint:docker-compose.yml#backend|POST|/orders|web/calls.ts:2', 'http_calls', 'compose:service:docker-compose.yml#web', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|POST|/orders'),
    ],
    "adp12_python_http_calls": [
        ('edge', 'python-http-calls:http_calls:compose:service:docker-compose.yml#stock->python-http-calls:external_api:rates.example|stock/client.py:3', 'http_calls', 'compose:service:docker-compose.yml#stock', 'python-http-calls:external_api:rates.example'),
        ('node', 'python-http-calls:external_api:rates.example', 'external_api', None, None),
    ],
    "adp12_java_http_calls": [
        ('edge', 'java-http-calls:http_calls:compose:service:docker-compose.yml#shop->ts-api-routes:http_endpoint:docker-compose.yml#stock|GET|/stock/items|shop/src/Feign.java:3', 'http_calls', 'compose:service:docker-compose.yml#shop', 'ts-api-routes:http_endpoint:docker-compose.yml#stock|GET|/stock/items'),
    ],
    "adp12_dotnet_http_calls": [
        ('edge', 'dotnet-http-calls:http_calls:compose:service:docker-compose.yml#bill->ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/rates|bill/Client.cs:1', 'http_calls', 'compose:service:docker-compose.yml#bill', 'ts-api-routes:http_endpoint:docker-compose.yml#backend|GET|/rates'),
    ],
    "adp13_grpc_proto": [
        ('edge', 'grpc-proto:documents:grpc-proto:external_api:Orders->grpc-proto:grpc_method:Orders/Get', 'documents', 'grpc-proto:external_api:Orders', 'grpc-proto:grpc_method:Orders/Get'),
        ('edge', 'grpc-proto:documents:grpc-proto:external_api:Orders->grpc-proto:grpc_method:Orders/Put', 'documents', 'grpc-proto:external_api:Orders', 'grpc-proto:grpc_method:Orders/Put'),
        ('edge', 'grpc-proto:exposes:compose:service:docker-compose.yml#proto->grpc-proto:grpc_method:Orders/Get', 'exposes', 'compose:service:docker-compose.yml#proto', 'grpc-proto:grpc_method:Orders/Get'),
        ('edge', 'grpc-proto:exposes:compose:service:docker-compose.yml#proto->grpc-proto:grpc_method:Orders/Put', 'exposes', 'compose:service:docker-compose.yml#proto', 'grpc-proto:grpc_method:Orders/Put'),
        ('node', 'grpc-proto:external_api:Orders', 'external_api', None, None),
        ('node', 'grpc-proto:grpc_method:Orders/Get', 'grpc_method', 'grpc-proto:external_api:Orders', None),
        ('node', 'grpc-proto:grpc_method:Orders/Put', 'grpc_method', 'grpc-proto:external_api:Orders', None),
    ],
    "adp14_java_grpc_calls": [
        ('edge', 'java-grpc-calls:http_calls:compose:service:docker-compose.yml#shop->grpc-proto:grpc_method:Orders/get|shop/src/Grpc.java', 'http_calls', 'compose:service:docker-compose.yml#shop', 'grpc-proto:grpc_method:Orders/get'),
    ],
    "adp16_angularjs_ui": [
        ('edge', 'angularjs-ui:binds_service:angularjs-ui:ui_app:old->compose:service:docker-compose.yml#old', 'binds_service', 'angularjs-ui:ui_app:old', 'compose:service:docker-compose.yml#old'),
        ('edge', 'angularjs-ui:contains:angularjs-ui:ui_app:old->angularjs-ui:ui_module:old/app.js:old', 'contains', 'angularjs-ui:ui_app:old', 'angularjs-ui:ui_module:old/app.js:old'),
        ('edge', 'angularjs-ui:contains:angularjs-ui:ui_app:old->angularjs-ui:ui_route:old/app.js:/start', 'contains', 'angularjs-ui:ui_app:old', 'angularjs-ui:ui_route:old/app.js:/start'),
        ('node', 'angularjs-ui:ui_app:old', 'ui_app', None, None),
        ('node', 'angularjs-ui:ui_module:old/app.js:old', 'ui_module', 'angularjs-ui:ui_app:old', None),
        ('node', 'angularjs-ui:ui_route:old/app.js:/start', 'ui_route', 'angularjs-ui:ui_app:old', None),
    ],
}
