"""Python gRPC calls under their services' full names."""

from graphloom.sources.extract import REGISTRY


def test_packages():
    text = """import grpc
import shop.v1.orders_pb2_grpc as pb
from shop.v2 import carts_pb2_grpc
from stock.items_pb2_grpc import ItemServiceStub as S, other
class A:
    def __init__(self, ch):
        self.orders = pb.OrdersStub(ch)
        carts: carts_pb2_grpc.CartsStub = make(ch)
        typed: pb.BillService = make(ch)
        s = S(ch)
        self.orders.GetOrder(r); carts.Add(x); s.Take(1); s.close(); plain.Thing(1); typed.Pay(1); s.Not_rpc(1)
p = LocalStub(ch)
p.Go(1)
"""
    got = {(f["name"], f["line"]) for f in REGISTRY["python-grpc-calls"][1]("a.py", text)}
    assert got == {("shop.v1.Orders/GetOrder", 11), ("shop.v2.Carts/Add", 11), ("stock.ItemService/Take", 11), ("shop.v1.BillService/Pay", 11), ("Local/Go", 13)}
