"""Transport similarity inside the JVM: a kernel in Java, compiled by the compiler that Spark itself brings (Janino).

Pairs are many and each is a small problem of its own, too irregular for numpy.  ``kernels.transport_similarity`` is the
same function of one similarity matrix, and what this one is tested against.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

#: Sets as bytes: words in order, each item's places among them in both fields, its seconds.  ``PackSet`` makes them from items (two
#: arrays of words, seconds), ``MergeSets`` of the parts of a set.
PACK = """
package spanloom.jvm;
import java.io.*;
import java.util.*;
import org.apache.spark.sql.Row;

public class PackSet implements org.apache.spark.sql.api.java.UDF1 {
  static void put(DataOutputStream out, int v) throws IOException {
    for (; v >= 128; v >>>= 7) out.writeByte(v & 127 | 128);
    out.writeByte(v);
  }

  // one character a byte, so that strings are in the order of their bytes
  static String[] bytewise(Object words) throws IOException {
    scala.collection.Seq s = (scala.collection.Seq) words;
    String[] out = new String[s.length()];
    for (int k = 0; k < out.length; k++) out[k] = new String(((String) s.apply(k)).getBytes("UTF-8"), "ISO-8859-1");
    return out;
  }

  public Object call(Object items) throws Exception {
    scala.collection.Seq rows = (scala.collection.Seq) items;
    String[][][] fields = new String[2][rows.length()][];
    double[] seconds = new double[rows.length()];
    for (int i = 0; i < rows.length(); i++) {
      Row r = (Row) rows.apply(i);
      for (int f = 0; f < 2; f++) fields[f][i] = bytewise(r.get(f));
      seconds[i] = r.getDouble(2);
    }
    return pack(fields, seconds);
  }

  static byte[] pack(String[][][] fields, double[] seconds) throws IOException {
    TreeMap words = new TreeMap();
    for (int f = 0; f < 2; f++)
      for (int i = 0; i < seconds.length; i++)
        for (int k = 0; k < fields[f][i].length; k++) words.put(fields[f][i][k], null);
    ByteArrayOutputStream bytes = new ByteArrayOutputStream();
    DataOutputStream out = new DataOutputStream(bytes);
    put(out, words.size());
    put(out, seconds.length);
    int at = 0;
    for (Iterator it = words.entrySet().iterator(); it.hasNext();) {
      Map.Entry e = (Map.Entry) it.next();
      byte[] w = ((String) e.getKey()).getBytes("ISO-8859-1");
      put(out, w.length);
      out.write(w);
      e.setValue(Integer.valueOf(at++));
    }
    for (int f = 0; f < 2; f++)
      for (int i = 0; i < seconds.length; i++) {
        put(out, fields[f][i].length);
        for (int k = 0; k < fields[f][i].length; k++) put(out, ((Integer) words.get(fields[f][i][k])).intValue());
      }
    for (int i = 0; i < seconds.length; i++) {
      double ms = Math.rint(seconds[i] * 1000);
      boolean whole = ms >= 0 && ms < 1e9 && ms / 1000 == seconds[i];
      put(out, whole ? (int) ms + 1 : 0); // 0: not of whole milliseconds, written in full
      if (!whole) out.writeDouble(seconds[i]);
    }
    return bytes.toByteArray();
  }
}

class Items {
  byte[][] words;
  int[][][] fields = new int[2][][];
  double[] seconds;

  static int get(java.nio.ByteBuffer in) {
    int v = 0;
    for (int shift = 0;; shift += 7) {
      int x = in.get();
      v |= (x & 127) << shift;
      if (x >= 0) return v;
    }
  }

  Items(byte[] packed) {
    java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap(packed);
    words = new byte[get(in)][];
    int n = get(in);
    for (int i = 0; i < words.length; i++) {
      words[i] = new byte[get(in)];
      in.get(words[i]);
    }
    for (int f = 0; f < 2; f++) {
      fields[f] = new int[n][];
      for (int i = 0; i < n; i++) {
        int[] own = new int[get(in)];
        for (int k = 0; k < own.length; k++) own[k] = get(in);
        fields[f][i] = own;
      }
    }
    seconds = new double[n];
    for (int i = 0; i < n; i++) {
      int ms = get(in);
      seconds[i] = ms > 0 ? (ms - 1) / 1000.0 : in.getDouble();
    }
  }

  double[] shares() {
    double total = 0;
    for (int i = 0; i < seconds.length; i++) total += seconds[i];
    double[] out = new double[seconds.length];
    for (int i = 0; i < out.length; i++) out[i] = total > 0 ? seconds[i] / total : 1.0 / out.length;
    return out;
  }
}

public class MergeSets implements org.apache.spark.sql.api.java.UDF1 {
  public Object call(Object sets) throws Exception {
    scala.collection.Seq all = (scala.collection.Seq) sets;
    if (all.length() == 1) return all.apply(0);
    LinkedHashMap seconds = new LinkedHashMap(); // of both fields' words
    for (int s = 0; s < all.length(); s++) {
      Items own = new Items((byte[]) all.apply(s));
      for (int i = 0; i < own.seconds.length; i++) {
        ArrayList key = new ArrayList();
        for (int f = 0; f < 2; f++) {
          ArrayList words = new ArrayList();
          for (int k = 0; k < own.fields[f][i].length; k++) words.add(new String(own.words[own.fields[f][i][k]], "ISO-8859-1"));
          key.add(words);
        }
        double[] sum = (double[]) seconds.get(key);
        if (sum == null) seconds.put(key, sum = new double[1]);
        sum[0] += own.seconds[i];
      }
    }
    String[][][] fields = new String[2][seconds.size()][];
    double[] sums = new double[seconds.size()];
    int at = 0;
    for (Iterator it = seconds.entrySet().iterator(); it.hasNext(); at++) {
      Map.Entry e = (Map.Entry) it.next();
      for (int f = 0; f < 2; f++) {
        ArrayList words = (ArrayList) ((ArrayList) e.getKey()).get(f);
        fields[f][at] = new String[words.size()];
        for (int k = 0; k < words.size(); k++) fields[f][at][k] = (String) words.get(k);
      }
      sums[at] = ((double[]) e.getValue())[0];
    }
    return PackSet.pack(fields, sums);
  }
}
"""

#: Exact largest similarity of a transport plan between two packed sets.  Shortest augmenting paths in phases: all paths of one
#: length are used up before the next length is looked for.  Lengths are whole (trillionths), so that equal ones are seen as equal.
MOVE = """
public class TransportSimilarity implements org.apache.spark.sql.api.java.UDF3 {
  static final double LEAST = 1e-12, UNITS = 1e12;
  static final long FAR = Long.MAX_VALUE;

  public Object call(Object a, Object b, Object share) {
    return Double.valueOf(similarity(new Items((byte[]) a), new Items((byte[]) b), ((Double) share).doubleValue()));
  }

  static double similarity(Items a, Items b, double share) {
    int n = a.seconds.length, m = b.seconds.length;
    int[] same = new int[b.words.length]; // b's words as places among a's, or -1
    for (int i = 0, j = 0; j < same.length; j++) {
      int way = -1;
      while (i < a.words.length && (way = Arrays.compareUnsigned(a.words[i], b.words[j])) < 0) i++;
      same[j] = i < a.words.length && way == 0 ? i : -1;
    }
    // sim[i]: similarities of a's item i to those of b's items, cols[i], with which it has a word in common
    double[][] sim = new double[n][];
    int[][] cols = new int[n][], rows = new int[m][];
    int[] degree = new int[m], both = new int[m], touched = new int[m];
    double[][] parts = new double[n][];
    int[][][] holds = new int[2][a.words.length][];
    for (int f = 0; f < 2; f++) {
      int[] size = new int[a.words.length];
      for (int j = 0; j < m; j++)
        for (int k = 0; k < b.fields[f][j].length; k++) {
          int w = same[b.fields[f][j][k]];
          if (w < 0) continue;
          if (holds[f][w] == null) holds[f][w] = new int[4];
          if (size[w] == holds[f][w].length) holds[f][w] = Arrays.copyOf(holds[f][w], 2 * size[w]);
          holds[f][w][size[w]++] = j;
        }
      for (int w = 0; w < size.length; w++) if (holds[f][w] != null) holds[f][w] = Arrays.copyOf(holds[f][w], size[w]);
    }
    double[] row = new double[m];
    double most = 0;
    for (int i = 0; i < n; i++) {
      int met = 0;
      for (int f = 0; f < 2; f++) {
        int[] x = a.fields[f][i];
        double part = f == 0 ? share : 1 - share;
        for (int k = 0; k < x.length; k++) {
          int[] js = holds[f][x[k]];
          for (int h = 0; js != null && h < js.length; h++) both[js[h]]++;
        }
        for (int k = 0; k < x.length; k++) {
          int[] js = holds[f][x[k]];
          for (int h = 0; js != null && h < js.length; h++) {
            int j = js[h];
            if (both[j] == 0) continue;
            double s = part * ((double) both[j] / (x.length + b.fields[f][j].length - both[j]));
            both[j] = 0;
            if (row[j] == 0 && s > 0) touched[met++] = j;
            row[j] += s;
          }
        }
      }
      sim[i] = new double[met];
      cols[i] = Arrays.copyOf(touched, met);
      for (int k = 0; k < met; k++) {
        int j = cols[i][k];
        sim[i][k] = row[j];
        row[j] = 0;
        degree[j]++;
        if (sim[i][k] > most) most = sim[i][k];
      }
    }
    return most > 0 ? move(sim, cols, degree, a.shares(), b.shares(), Math.round(most * UNITS)) : 0.0;
  }

  // supply and demand are used up
  static double move(double[][] sim, int[][] cols, int[] degree, double[] supply, double[] demand, long most) {
    int n = supply.length, m = demand.length;
    long[][] cost = new long[n][];
    double[][] flow = new double[n][];
    int[][] heldBy = new int[m][], heldAt = new int[m][]; // rows of a column, and its place in each
    int[] filled = new int[m];
    for (int j = 0; j < m; j++) {
      heldBy[j] = new int[degree[j]];
      heldAt[j] = new int[degree[j]];
    }
    for (int i = 0; i < n; i++) {
      cost[i] = new long[cols[i].length];
      flow[i] = new double[cols[i].length];
      for (int k = 0; k < cols[i].length; k++) {
        int j = cols[i][k];
        cost[i][k] = most - Math.round(sim[i][k] * UNITS);
        heldBy[j][filled[j]] = i;
        heldAt[j][filled[j]++] = k;
      }
      if (cols[i].length == 0) supply[i] = 0;
    }
    // rows are the nodes 0 to n - 1, columns follow
    long[] potential = new long[n + m], dist = new long[n + m];
    boolean[] done = new boolean[n + m];
    int[] path = new int[n + m], arc = new int[n + m]; // nodes of a path, and of each node the arc it tries
    for (long length = 0;;) {
      for (int v = 0; v < n + m; v++) {
        dist[v] = v < n && supply[v] > LEAST ? 0 : FAR;
        done[v] = false;
      }
      long reach = FAR;
      while (true) {
        int u = -1;
        for (int v = 0; v < n + m; v++) if (!done[v] && dist[v] < FAR && (u < 0 || dist[v] < dist[u])) u = v;
        if (u < 0) break;
        if (u >= n && demand[u - n] > LEAST) {
          reach = dist[u];
          break;
        }
        done[u] = true;
        if (u < n) {
          for (int k = 0; k < cols[u].length; k++) {
            int v = n + cols[u][k];
            long d = dist[u] + cost[u][k] + potential[u] - potential[v];
            if (d < dist[v]) dist[v] = d;
          }
        } else {
          int j = u - n;
          for (int h = 0; h < heldBy[j].length; h++) {
            int v = heldBy[j][h], k = heldAt[j][h];
            if (flow[v][k] <= LEAST) continue;
            long d = dist[u] + potential[u] - potential[v] - cost[v][k];
            if (d < dist[v]) dist[v] = d;
          }
        }
      }
      if (reach == FAR || length + reach >= most) break; // gains only shrink, so nothing more can be won
      length += reach;
      for (int v = 0; v < n + m; v++) {
        potential[v] += Math.min(dist[v], reach);
        done[v] = false;
      }
      // all paths of this length: depth first along arcs without reduced cost; where one got stuck is not tried again
      for (int start = 0; start < n; start++) {
        while (supply[start] > LEAST && !done[start]) {
          int depth = 0;
          path[0] = start;
          arc[start] = -1;
          done[start] = true;
          while (depth >= 0) {
            int u = path[depth];
            if (u >= n && demand[u - n] > LEAST) break;
            int next = -1;
            if (u < n) {
              while (next < 0 && ++arc[u] < cols[u].length) {
                int v = n + cols[u][arc[u]];
                if (!done[v] && cost[u][arc[u]] + potential[u] == potential[v]) next = v;
              }
            } else {
              int j = u - n;
              while (next < 0 && ++arc[u] < heldBy[j].length) {
                int v = heldBy[j][arc[u]];
                if (!done[v] && flow[v][heldAt[j][arc[u]]] > LEAST) next = v;
              }
            }
            if (next < 0) {
              depth--;
            } else {
              path[++depth] = next;
              arc[next] = -1;
              done[next] = true;
            }
          }
          if (depth < 0) break;
          int end = path[depth] - n;
          double amount = Math.min(supply[start], demand[end]);
          for (int d = 1; d < depth; d += 2) {
            int j = path[d] - n;
            amount = Math.min(amount, flow[path[d + 1]][heldAt[j][arc[path[d]]]]);
          }
          supply[start] -= amount;
          demand[end] -= amount;
          for (int d = 0; d < depth; d++) {
            int u = path[d];
            if (u < n) flow[u][arc[u]] += amount; else flow[path[d + 1]][heldAt[u - n][arc[u]]] -= amount;
          }
          for (int d = 0; d <= depth; d++) done[path[d]] = false;
        }
      }
    }
    double won = 0;
    for (int i = 0; i < n; i++) for (int k = 0; k < cols[i].length; k++) won += flow[i][k] * sim[i][k];
    return won;
  }
}
"""


def _jar(spark: SparkSession) -> str:
    """A jar of the compiled kernel in a new folder."""
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(PACK + MOVE)
    folder = tempfile.mkdtemp(prefix="spanloom-jar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "spanloom-transport.jar")
    with zipfile.ZipFile(path, "w") as z:
        for e in compiler.getBytecodes().entrySet():
            z.writestr(e.getKey().replace(".", "/") + ".class", bytes(e.getValue()))
    return path


_loaders: dict[str, JavaObject] = {}


def register(spark: SparkSession) -> None:
    """The kernel's functions for this session; executors get the jar from the driver."""
    if spark.catalog.functionExists("spanloom_transport"):
        return
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        spark.sql(f"ADD JAR '{_jar(spark)}'")
        _loaders[app] = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    for name, cls, kind in (("spanloom_pack_set", "PackSet", BinaryType()), ("spanloom_merge_sets", "MergeSets", BinaryType()), ("spanloom_transport", "TransportSimilarity", DoubleType())):
        made = _loaders[app].loadClass(f"spanloom.jvm.{cls}").newInstance()
        spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType(kind.json()))


def packed(items: Column) -> Column:
    return F.call_function("spanloom_pack_set", items)


def merged(sets: Column) -> Column:
    """One packed set of an array of such: seconds of equal items are added."""
    return F.call_function("spanloom_merge_sets", sets)


def transport(a: Column, b: Column, action_share: float) -> Column:
    """Transport similarity of two packed sets, neither null."""
    return F.call_function("spanloom_transport", a, b, F.lit(action_share))
