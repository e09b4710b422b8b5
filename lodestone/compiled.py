"""Functions of the JVM from Java source beside the code, for loops that neither columns nor arrays can hold.

The compiler is the one that Spark itself compiles its plans with, so nothing is installed; executors get the classes
as a jar from the driver.
"""

from __future__ import annotations

import zipfile
from importlib import resources

from pyspark.sql import SparkSession

_loaders: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, package: str, kind: str):
    """A class loader that has the class ``kind`` of the package's source of this name; compiled once an application."""
    key = (spark.sparkContext.applicationId, kind)
    if key not in _loaders:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(resources.files(package).joinpath(f"{kind}.java").read_text())
        path = f"{spark.sparkContext._temp_dir}/{kind}.jar"  # removed with the application
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{path}'")
        _loaders[key] = spark._jsparkSession.sharedState().jarClassLoader()
    return _loaders[key]


def register(spark: SparkSession, name: str, package: str, kind: str, returns: str) -> None:
    """Registers the class ``kind``, one of Spark's UDF interfaces, as the function ``name`` of the session.

    It is called not deterministic, lest the plan repeat a costly call in a filter.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    made = _loader(spark, package, kind).loadClass(f"lodestone.{kind}").getDeclaredConstructor(array(jvm.Class, 0)).newInstance(array(jvm.Object, 0))
    function = jvm.org.apache.spark.sql.functions.udf(made, jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    spark._jsparkSession.udf().register(name, function.asNondeterministic())
