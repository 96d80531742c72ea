import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
