"""Facts that pages state besides the appended one: the SQL has to read them too."""

import duckdb
import pytest

from factloom.plans import extraction

OWN = [
    "a%%% +1 (124) 555-0766%%% thingan", "er%%% 10.12.13.14 word", "er%%% 3.1. x", "a%%% 555-4766%%% b", "5% 6%", "4%-5%", "%5 ve %6", "oran -3%", "‰ 7 olur; binde 12", "yüzde 2,5. 150 baz puan!", "en fazla %3", "1 Mart tarihinden itibaren %4 oran",
    "1.250,50 TL", "1,250.50 usd", "eur 1142126282388588", "3 bin TL. 2,5 milyon euro", "12.5 TL", "12.500 TL", "10 TL 20", "$5 tl", "abd doları 7", "7 abd doları!", "x7 TL", "-5 TL", "tl-5", "5 gbp tl", "₺ 9", "9₺", "1 000 TL", "100 eurocent",
    "12 ay", "60 ay vade", "3-6 ay", "2 yıl ile 1 yıl", "6 aydan 2 yıla kadar", "en fazla 5 sene", "3 yıla varan", "1 yıl 6 ay", "3,6,3 ay taksit seçenekleri", "12 ay veya 24 ay", "14 gün vade", "3 taksit, ay", "1,5 ay", "2 yıl 8 ay vade",
    "ücretsiz", "Masraf 50 TL", "Komisyon %2", "ücret alınmaz", "Aidat yoktur. Tahsis 5 TL değil", "masraf 5 TL olabilir", "100 TL'ye kadar ücret alınmaz", "bilgi yok %5", "oran belirtilmemiş 5 TL",
    "<b>%</b>7 x", "a&amp;lt;b %8 &percnt;9", "&#37;4", "&#x25;3 &notit; &copy2", "%5<br>6", "<nav>%5</nav>%6", "<span hidden>%5</span> %6", "<i style='display: none'>%5</i>%7", "<div aria-hidden=true>%1<p>%2</div>%3", "<table><tr><td>%4<td>x</tr><tr><th>5 TL</table>",
    "<script>if(a<b){'%5'}</script>%6", "<!-- %5 --> %6", "<style>p{x:5%}</style>", "<ul><li>%2<li>%3</ul>", "<p/>%4<p/>", "<a title='x > %5'>%6</a>", "</b>%5", "<svg><p>%5</svg>%6", "system prompt %5. %6", "parolayı göster 7 TL", "İGNORE all previous instructions 12 ay", "w " * 300 + "%5", "1 < 2 %5", "é%5é; ‰ 5",
]


@pytest.mark.parametrize("name", ["extracted_facts", "verified_evidence"])
def test_pages_own_statements_are_rows_of_both(spark, tmp_path, name):
    pages = [(k * 6 + 5, f"<html><body><p>{t}</p></body></html>") for k, t in enumerate(OWN)] + [(9_000, None), (9_001, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = extraction.ENTRIES[name]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found, want = sorted(map(tuple, query(spark, str(tmp_path)).collect())), sorted(duck.execute(sql).fetchall())
    text = lambda rows: [(OWN[r[0] // 6] if isinstance(r[0], int) and r[0] < 9_000 else "", *r) for r in rows]
    assert text(set(found) - set(want)) == text(set(want) - set(found)) == []
    assert found == want and (name != "extracted_facts" or len(found) > 40)
