"""A small mixed repository, one or two files for each extractor: input of the extraction and adapter queries."""

FILES = {
    "tools/load.py": "import os\nfrom .base import Reader\nLIMIT = 5\nclass Loader(Reader):\n    def run(self):\n        return os\n",
    "tools/base.py": "class Reader:\n    def close(self):\n        pass\n",
    "native/grid.cpp": "#include <vector>\n#include \"grid.h\"\nclass Grid {\n};\nint area(int w, int h) {\n  return w * h;\n}\n",
    "shop/src/Cart.java": "package shop;\nimport java.util.List;\npublic class Cart extends Base implements Closeable {\n  public void add(int n) {\n  }\n}\n",
    "bill/Invoice.cs": "using System;\nnamespace Bill;\npublic class Invoice : Document, IPrintable\n{\n  public void Print() { }\n}\n",
    "web/model.ts": "import { x } from \"./other\";\nexport class Model extends Store {\n}\nexport function open(a) {}\n",
    "docker-compose.yml": "services:\n  api:\n    image: acme/api\n    depends_on: [db]\n  db:\n    image: postgres:16\n",
    "api/appsettings.json": "{\"ConnectionStrings\": {\"Main\": \"Host=db1;Password=x;Provider=Npgsql\"}, \"Bus\": \"amqp://u:p@mq:5672\"}",
    "api/openapi.yaml": "openapi: 3.0.0\ninfo: {title: Shop API}\npaths:\n  /carts:\n    get: {operationId: list}\n    post: {}\n",
    "bill/Bill.csproj": "<Project Sdk=\"Microsoft.NET.Sdk.Web\"><ItemGroup><ProjectReference Include=\"..\\core\\Core.csproj\"/><PackageReference Include=\"Polly\"/></ItemGroup></Project>",
    "core/Core.csproj": "<Project Sdk=\"Microsoft.NET.Sdk\"></Project>",
    "shop/pom.xml": "<project><parent><groupId>g</groupId><artifactId>root</artifactId></parent><artifactId>shop</artifactId><dependencies><dependency><artifactId>spring-boot-starter-web</artifactId></dependency></dependencies></project>",
    "mail/build.gradle": "plugins {\n  id \"org.springframework.boot\" version \"3.2.0\"\n}\ngroup = \"g\"\n",
    "shop/application.yml": "server:\n  port: 8081\nspring:\n  datasource:\n    url: jdbc:postgresql://pg:5432/shop\n",
    "mail/Rabbit.java": "class Listener {\n  @RabbitListener(queues = \"orders\")\n  public void on(OrderEvent e) {}\n  void send() { rabbitTemplate.convertAndSend(\"mails\", x); }\n}\n",
    "mail/Kafka.java": "class Stream {\n  @KafkaListener(topics = \"bills\")\n  public void on(final BillEvent e) {}\n  void send() { kafkaTemplate.send(\"acks\", x); }\n}\n",
    "backend/routes.ts": "const BASE = \"/v1\";\napp.get<{ X: 1 }>(\"/carts\", h);\napp.post(`${BASE}/carts`, h);\n",
    "bill/OrdersController.cs": "[Route(\"api/[controller]\")]\npublic class OrdersController {\n  [HttpGet(\"{id}\")]\n  public string Get(int id) { return \"\"; }\n}\n",
    "shop/src/CartController.java": "@RequestMapping(\"/api\")\nclass CartController {\n  @GetMapping(\"/carts\")\n  List<Cart> all() { return null; }\n}\n",
    "stock/views.py": "router = APIRouter(prefix=\"/stock\")\n@router.get(\"/items\")\ndef items():\n    pass\nurlpatterns = [path(\"old/\", legacy), path(\"more/\", include(\"stock.more\"))]\n",
    "web/calls.ts": "api.get(`/carts/${id}`);\nfetch(\"/orders\", { method: \"POST\" });\n",
    "bill/Client.cs": "var r = await http.GetAsync(\"/rates\");\n",
    "shop/src/Feign.java": "@FeignClient(name = \"stock\")\ninterface Stock {\n  @GetMapping(\"/stock/items\")\n  String items();\n}\n",
    "stock/client.py": "import httpx\nc = httpx.Client(base_url=\"http://rates.example\")\nc.get(\"/today\")\n",
    "proto/orders.proto": "package orders;\nservice Orders {\n  rpc Get (Id) returns (stream Order) {}\n  rpc Put(stream Order) returns (Id);\n}\n",
    "web/grpc.ts": "orderClient.getOrder(x);\n",
    "shop/src/Grpc.java": "class G { void f() { s = OrdersGrpc.newBlockingStub(c); s.get(r); } }\n",
    "bill/Grpc.cs": "var c = new Orders.OrdersClient(channel);\nc.GetAsync(r);\n",
    "stock/grpc.py": "s = pb.OrdersStub(channel)\ns.Get(r)\n",
    "web/CartPage.tsx": "import \"./cart.css\";\n<Route path=\"/cart\" element={<CartPage/>}/>\nexport function CartPage() { api.get(\"/carts\"); navigate(\"/cart\"); return <button name=\"buy\">Buy</button>; }\n",
    "ng/routes.ts": "const routes = [{ path: \"home\", component: HomeComponent }];\n@Component({ selector: \"app-home\" })\nexport class HomeComponent {}\n",
    "old/app.js": "angular.module(\"old\", []);\n$stateProvider.state(\"start\", {url: \"/start\"});\n$http.get(\"/api/start\");\n",
    "web/package.json": "{\"name\": \"web\", \"dependencies\": {\"react\": \"18.0.0\"}}",
    "broken/bad.py": "def (:\n",
}
