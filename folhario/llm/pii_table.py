"""The labelled table that the personal-data model is trained on.

It is small (`rows` pages of a few sentences) and made from a rule: sentence frames of
the kind court papers use, filled with invented people, numbers and places in the ways
people write them. A slot that names a kind of item is labelled with it, everything
else is text. The same seed gives the same table.
"""

from __future__ import annotations

import random
import re

KINDS = ("name", "cpf", "rg", "pis", "email", "phone", "address")
GIVEN = (
    "Maria José Ana João Antônio Francisco Carlos Paulo Pedro Lucas Luiz Luís Marcos Gabriel Rafael Daniel Marcelo Bruno Eduardo Felipe Raimundo Rodrigo Manoel Mateus André Fernando Fábio Leonardo "
    "Gustavo Guilherme Leandro Tiago Anderson Ricardo Márcio Jorge Sebastião Alexandre Roberto Edson Diego Vitor Sérgio Cláudio Geraldo Adriano Luciano Júlio Renato Alex Vinícius Rogério Samuel Ronaldo Mário "
    "Adriana Juliana Márcia Fernanda Patrícia Aline Sandra Camila Amanda Bruna Jéssica Letícia Júlia Luciana Vanessa Mariana Gabriela Vera Vitória Larissa Cláudia Beatriz Luana Rita Sônia Renata Eliane "
    "Helena Lúcia Rosa Teresa Isaura Cecília Regina Leonor Adélia Eunice Mercedes Aparecida Irene Dalva Marta Graça Nair Edite Estela Olívia Sílvia Clara Conceição Natália Caetano Cícero Damião Heitor Celso "
    "Bernardo Joaquim Edmilson Inácio Nélson Lauro Vicente Flávio Benedito Gilberto Abel Ícaro Elísio Clóvis Moacir Djalma Arlindo Otávio Augusto Emília Amélia Lídia Jandira Alzira Áurea Lourdes Valéria Débora Elaine Ivone Josefa Margarida "
    "Hortência Anália Mônica Cândida Glória Bianca Joana Orlando Henrique Tomás Eugênio Miguel Hélio Fausto Jacinto Cristiano Maurício Arnaldo Fátima Francisca Luíza"
).split()
STREET = "Rua rua RUA R. R. R. R. R. Qd. Qd. Avenida Av. Travessa Trav. Praça Ladeira Alameda Rodovia Estrada Largo Beco Sítio Loteamento Conjunto Condomínio Fazenda Quadra Vila Chácara Via Povoado".split()
STREET_WORDS = frozenset("rua avenida av qd q travessa trav tv praça praca pça pca ladeira alameda al rodovia rod estrada estr largo lgo beco sítio sitio loteamento lot conjunto conj condomínio condominio cond fazenda faz quadra vila chácara chacara via viela povoado residencial".split())
TITLES = frozenset("sr sra dr dra srta prof profa dona des exmo exma ilmo".split())
PARTICLES = frozenset("de da do das dos e".split())
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
TRADES = (
    "Contador,Engenheiro,Arquiteto,Médico,Psicóloga,Enfermeiro,Economista,Bióloga,Químico,Tradutora,Dentista,Fisioterapeuta,Administrador,Agrônomo,Geóloga,Professor,Motorista,Eletricista,Corretor,Veterinária,"
    "Assistente Social,Médico do Trabalho,Engenheira Civil,Engenheiro de Minas,Técnico em Contabilidade,Analista de Sistemas,Terapeuta Ocupacional,Perito Contábil,Especialista em Redes,Cirurgião e Clínico"
).split(",")
FIRMS = "Construtora,Seguradora,Banco,Viação,Supermercados,Financeira,Cooperativa Agrícola,Hospital e Maternidade,Distribuidora de Energia,Companhia de Águas,Instituto de Previdência do Vale de,Fundo Estadual de Saúde de,Departamento de Estradas de,Agência de Defesa Rural de,Autarquia de Trânsito Municipal de,Superintendência de Obras Públicas de".split(",")
PLACES = "Campo,Lagoa,Vila,Monte,Barra,Pedra,Serra,Porto,Santo,Santa,São,Nova,Rio,Ribeirão,Alto,Ponta,Ilha,Nossa Senhora".split(",")
PLACE_ENDS = "Grande,Novo,Velho,Verde,Alegre,da Serra,do Norte,do Sul,das Flores,dos Montes".split(",")
#: Given and family names from elsewhere, as they turn up in Brazilian papers.
ABROAD = "Kauê Wesley Yuri Ingrid Yasmin Wanda Karen Ryan Thaís Wilson Jeferson Kelly Igor Nayara Uilson Ayrton Hugo Erika Washington Enzo Ketlin Walter Suely Jussara Iracema Tainá Ubirajara Gisele Peri".split()
FAMILY = "Silva Souza Santos Oliveira Pereira Lima Costa Rocha Azevedo Teixeira Cardoso Schmidt Weber Müller Kowalski Nowak Tanaka Yamada Suzuki Rossi Bianchi Ferrari Haddad Khoury Nakamura Becker Wagner Krüger Zanetti Watanabe".split()
_FOREIGN = "kow nak bran wey schu yam hof zan koz wit gru ryb kra tak sch mor rud wal yos kim".split()
_FOREIGN_END = "ski mura berg mann kawa ner wicz sen stein elli otto ini son yama czyk ler".split()
STREET_NAMES = "das Flores,do Comércio,Sete de Setembro,Quinze de Novembro,da Matriz,Principal,Beira Rio,Central,das Palmeiras,da Estação,São José,Santa Rita,Projetada,Sem Saída,da Ponte,do Alto".split(",")
ENDS = "example,invalid,test,com.br,org".split(",")
_ON = "Bar Cal Dor Fel Gal Jan Lim Mar Nor Pal Quin Ral Sil Tor Val Zam Bor Cre Dra Fro Gri Lor Mel Nar Per Pla Sar Tal Tre Vil Ver Bel Cor Far Gor Jam Lam Mun Tri Zan".split()
_MID = "a e i o be ca da fe ga ji la me na pe qui ra si ta ve zu lis ran ten vol bi do fa gui lo mi pi ro su ti va xi ze bam con dun fur".split()
_OFF = "ado anda ares aim eira elo ense iano ilha ino ires osa oso uda ume ura ândria éssio icão inque orém ucena ôndio estre usto aço edo into oni ante anha este iz ão eu ito alho ebra idade umo".split()
_OFF_MID = "bosa nhães rdade lhos rdeiro mpos quim xara spira ntela vares rgas ndes tto ffa lves nque sso ssara lvim bral mbu njo mbra stro rmo goso zes".split()

#: Frames; {slots} named by a kind are its items, others are plain text.
FRAMES = (
    "O perito {t}{name}, {trade}, CPF {cpf}, {aceitou} em {date} e {indicou} o e-mail {email} para {avisos}.",
    "A perita {t}{name}, {trade}, CPF {cpf}, {aceitou} em {date}.",
    "A testemunha {t}{name}, ouvida em {date}, {disse} que {reside} na {address} há {n} anos e {trabalha} {firm}.",
    "Depoente: {t}{name}. {Filiacao}: {t}{name} e {t}{name}. Identidade {rg}. Fone {phone}.",
    "O advogado {t}{name} (OAB/ZZ {nn}.{nnn}) {pediu} do laudo de {trade} pelo prazo de {n} dias, {segundo} petição nº {nnnn}.",
    "Falecido o autor {t}{name}, {apresentou} a viúva {t}{name}, CPF {cpf}, que {reside} na {address}.",
    "Intime-se {t}{name}, {morada} na {address}, nesta comarca de {place}, para {acto} no dia {date}{tail}.",
    "Intime-se {t}{name}, {morada} na {address}, na comarca de {place}, para {acto} no dia {date}.",
    "Documento assinado eletronicamente por {name}, em {date} às {hour}, {forma}",
    "Contato da secretaria: {email}",
    "Telefone e e-mail do {room}: {phone} ou {email}, {falar} com {t}{name}.",
    "Canais do {room}: {phone} ou {email}, {falar} com {t}{name}.",
    "Consta {da} o endereço eletrônico {email} e o {fone} {phone}, {semresposta} desde {date}{tail}.",
    "{Dados} para {pagamento}: favorecido {t}{name}; CPF {cpf}; RG {rg}; endereço {address}; telefone {phone}.",
    "{Dados} para {pagamento}: favorecido {t}{name}, CPF {cpf}, RG {rg}, telefone {phone}.",
    "A parte {t}{name}, {portadora} do RG nº {rg} e do CPF {cpf}, {informou} o telefone {phone} para {avisos}.",
    "{Nota} os autos nº {proc}, {movidos} por {t}{name} em face de {firm}, {fim} no valor de {money}{tail}.",
    "{Nota} que a conta {apontada}, agência {nnnn}-{d} conta {nnnnn}-{d}, {emnome} {t}{name}, PIS/NIT {pis}.",
    "{Anexou} aos autos o laudo de {trade} com {n} páginas, protocolo {proto}, {subscrito} por {t}{name} em {date}.",
    "Em resposta ao quesito {n}, o expert {t}{name} {disse} que {fato} o relato de {place}, fls. {nnnn}.",
    "O exame {ocorreu} na {address}, às {hour}, {presenca} do assistente técnico {t}{name}.",
    "Trata-se de {pedido} de honorários em favor {doperito} {t}{name}, {inscrito} no CPF {sobnr} {cpf}, {referente} perícia de {trade} {feita} nos autos nº {proc}.",
    "Trata-se de {pedido} de honorários em favor {doperito} {t}{name}, {inscrito} no CPF {sobnr} {cpf}, {referente} perícia de {trade} {feita} nos autos nº {proc}.",
    "Remetam-se os autos ao Fórum Des. {building}, {atencao} da servidora {t}{name}, ramal {nnnn}{tail}.",
    "Remetam-se os autos ao Fórum Des. {building}, {atencao} da servidora {t}{name}, ramal {nnnn}{tail}.",
    "Foi expedido ofício à empresa {firm}, CNPJ {cnpj}, com sede em {place}, {pedindo} cópia {docum} nº {nnnn}{tail}.",
    "A perícia de {trade} {designada} para {date} foi {transferida} para {date} por falta de {falta}, em {place}.",
    "O valor de {money}, {cargo} {firm}, foi {empenhado} sob o nº {nnnn}NE{nnnn} em {date}{tail}, na dotação {nnnn}.",
    "{Certifico}, em {date}, às {hour}, decorreu o prazo de {n} dias sem {manif} de {firm} no processo {padm}{tail}.",
    "{Arbitro} os honorários {para} {trade} em {money}, {naforma} da tabela {vig} de {place}, {segundo} a Resolução nº {nnnn}/{year}.",
    "Considerando a {manif} de {firm} às fls. {nnnn}, {mantenho} a nomeação para a especialidade de {trade} em {place}.",
    "{Compra} de {n} {pastas} @ {money} para a comarca de {place} consta do pedido {proto} e {refoge} {firm}.",
    "{Requisita} ao setor de {place} a devolução do processo {padm} até {date}, tendo em vista {falta}.",
    "PODER JUDICIÁRIO DO ESTADO DE {STATE}",
    "{court}",
    "{address} - {place}/ZZ - Fone: {phone}",
    "{address} - {place}/ZZ - Fone: {phone}",
    "Processo administrativo nº {padm} - {court}",
    "A autenticidade pode ser conferida em https://conferencia-{low}.example/v?codigo={hex} informando o código {hex}",
    "Pág. {n} de {nnnn} | {word}",
    "fl. {nnnn} - {word} - rubrica ______",
    "{Este} {vale} {court}.",
    "Leia também: pautas da {court}",
    "Receba avisos da {court} no seu painel",
    "Compartilhe este andamento com a sua equipe | {court}",
    "Avalie o atendimento da {court}",
    "Imprima apenas se necessário - {court} agradece",
    "VOLTAR AO TOPO » {COURT}",
    "{Short}",
    "Requerente: {t}{name}. Requerido: {firm}.",
    "Nomeio perito {t}{name}, com telefone {phone} e e-mail {email}.",
    "Assinam a ata {name} e {name}, residentes na {address}.",
    "Ciente o servidor {name}, matrícula {nnnnn}.",
    "Inscrito no PIS sob o nº {pis} e no CPF sob o nº {cpf}, {t}{name} declarou {fato} o relato de {place}.",
)
FRAMES += (
    "PODER JUDICIÁRIO DO ESTADO DE {STATE}\n{court}\n{address} - {place}/ZZ - Fone: {phone}",
    "{court}\n{address} - {place}/ZZ - Fone: {phone}",
    "{Anexou} aos autos o laudo de {trade} com {n} páginas, protocolo {proto}, {subscrito} por {t}{name} em {date}.",
    "{Anexou} a petição de protocolo {proto}, {subscrito} por {t}{name} em {date}.",
    "{Dados} para {pagamento}: favorecido {name}; CPF {cpf}; RG {rg}; endereço {address}; telefone {phone}.",
)
#: Frames of other papers: notes, letters, forms, messages.
OTHER_FRAMES = (
    "{Past} {t}{name}, {trade}, {reside} na {address}, {phone}.",
    "{Past} em {date} {t}{name} e {name}.",
    "{Ola}, {falo} com {name}? {Ligue} para {phone} ou {escreva} para {email}.",
    "{Who}: {name}, {years} anos. CPF: {cpf}. RG: {rg}.",
    "{Who}: {name}\nEndereço: {address}\nTelefone: {phone}\nE-mail: {email}",
    "{Enviar} para {name}, {address}, {place}.",
    "{Bom}, {name}! Segue {docum} nº {nnnn} de {date}, qualquer dúvida {phone}.",
    "{Who} {name} ({trade}), tel. {phone}, {reside} em {place}.",
    "Na reunião de {date}, {name} {disse} que {firm} {word2} o valor de {money}.",
    "{name} {past} {docum} a {name} por {money}.",
    "Segundo {t}{name}, {trade} de {firm}, o prazo {word2} em {date}.",
    "O sr. {name} e a sra. {name} {word2} na {address} desde {year}.",
    "Atenciosamente,\n{name}\n{trade}",
    "{Who}: {name} - PIS {pis} - {phone}",
    "A {firm}, com sede na {address}, {word2} {docum} de {name}.",
    "A {place} {word2} {n} {words} e {word2} {words} em {date}, segundo {firm}.",
    "{Enviar} {docum} ao {building2} até {date}, sala {nnn}, {word2} {words}.",
    "{Past} {words} de {place} em {date}: {n} {words}, {money}.",
    "Entregar na {address}, aos cuidados de {name}, fone {phone}.",
    "Responsável: {name} | {email} | {phone}",
)
#: What stands alone in a tax-number field.
VALUES = (
    "{cpf}", "{cpf}", "{cpf}", "{cpf}", "{cpf}", "{cpf}", "{cpf}", "CPF nº {cpf}", "cpf {cpf}", "CPF: {cpf}", "C.P.F. {cpf}", "{cpf} (conforme cadastro)", "{cpf}, RG a apresentar", "{cpf}\n\nTrata", "NIT: {pis}", "PIS {pis}", "PIS/NIT {pis}",
    "{cnpj}", "{cnpj}", "***.{nnn}.{nnn}-**", "***.{nnn}.{nnn}-**", "{proc}", "não localizado", "n/d", "N/A", "Banco {nnn} ag. {nnnn}", "vide fls. {nnn}", "vide fls. {n}", "matrícula {nnnnn}", "{email}", "{email}", "{email}", "{phone}", "{phone}", "RG {rg}",
    "{name}", "{address}", "conta {nnnnn}-{d}", "protocolo {proto}", "OAB/ZZ {nn}.{nnn}",
)
PLAIN = {
    "Past": "Compareceu|Chegou|Assinou|Recebi|Falei com|Atendi|Visitei|Faleceu|Chamou|Entrou|Foi ouvida|Veio", "past": "vendeu|entregou|mostrou|pediu|cedeu", "Ola": "Olá|Oi|Boa tarde|Prezados", "falo": "falo|estou falando|posso falar", "Ligue": "Ligue|Telefone|Retorne",
    "escreva": "escreva|mande", "Who": "Paciente|Cliente|Aluna|Contato|Nome|Titular|Segurado|Comprador|Locatária|Remetente|Destinatário|Médica|Sócio", "Enviar": "Enviar|Entregar|Mandar|Remeter|Encaminhar", "Bom": "Bom dia|Boa tarde|Cara|Caro",
    "building2": "Hospital {building}|Colégio {building}|Edifício {building}|Posto {word}|Ginásio {word}",
    "Filiacao": "Filiação|Genitores|Pais", "aceitou": "aceitou o encargo|assumiu a função|firmou compromisso", "indicou": "indicou|forneceu|registrou", "avisos": "avisos|intimações|ciência|contato|recado|retorno", "disse": "disse|afirmou|contou|declarou|respondeu",
    "reside": "reside|mora|vive|recebe correspondência|pode ser encontrada", "trabalha": "trabalha em|é vizinha de|presta serviço a", "pediu": "pediu vista|requereu cópia|solicitou cópia|pediu carga|pediu cópia|requereu vista", "segundo": "segundo|conforme|observada",
    "apresentou": "apresentou-se|compareceu|habilitou-se", "morada": "com morada|residente|domiciliada", "acto": "comparecer ao exame|acompanhar a vistoria|retirar o alvará|prestar depoimento", "tail": "|, com ressalva de sala acessível em {word}|, dada a falta de quórum em {word}|, à espera de laudo complementar em {word}|, pendente resposta do cartório em {word}|, sem prejuízo de transporte do periciando em {word}|, observado o tema assinatura válida em {word}",
    "forma": "na forma da lei|conforme horário oficial|com certificado próprio", "room": "consultório|escritório|gabinete", "falar": "falar|tratar|agendar", "da": "da ficha|do sistema|no cadastro", "fone": "telefone|celular|número", "semresposta": "sem confirmação|ambos sem resposta|conferidos por último|já sem resposta",
    "Dados": "Dados|Elementos|Informações", "pagamento": "pagamento|empenho|cadastro", "portadora": "portadora|titular", "informou": "informou|declinou|deixou anotado", "Nota": "Nota-se|Vistos|Analisei|Compulsando|Examinados|Verifica-se|Observa-se|Constata-se", "movidos": "movidos|propostos|ajuizados",
    "fim": "com pedido de reserva|para fins de arbitramento|com pretensão de reserva|para fins de fixação", "apontada": "apontada|informada|indicada", "emnome": "pertence a|tem como titular|está em nome de", "Anexou": "Anexou-se|Acostou-se|Juntou-se", "subscrito": "subscrito|assinado|firmado",
    "fato": "a falha coincide com|a rubrica não decorre de|a lesão decorre de|o dano não coincide com", "ocorreu": "ocorreu|teve lugar|foi feito", "presenca": "na presença|sem objeção|com a participação", "pedido": "pedido|cobrança|solicitação|requisição", "sobnr": "sob o nº|com o nº|de nº",
    "referente": "referente à|relativo à|pela", "doperito": "do perito|da perita|do profissional|da profissional|do expert|de", "inscrito": "inscrito|cadastrado|registrado", "feita": "feita|realizada|concluída", "atencao": "à atenção|por intermédio|aos cuidados", "pedindo": "pedindo|solicitando|requisitando", "docum": "da planilha|do contrato|da apólice", "designada": "designada|prevista|marcada", "transferida": "transferida|remarcada|adiada",
    "falta": "sala acessível|energia no prédio|resposta do cartório|intimação do assistente|saldo na dotação|documentos originais|transporte do periciando", "empenhado": "empenhado|reservado|lançado", "Certifico": "Certifico que|Dou fé de que|Atesto que", "cargo": "a cargo de|devido por|pago por", "manif": "manifestação|impugnação|resposta|cota",
    "Arbitro": "Arbitro|Fixo|Mantenho|Estimo", "para": "de|para|da área de", "naforma": "na forma|de acordo com os valores|nos moldes", "vig": "vigente|local|anexa", "mantenho": "mantenho|reconsidero|confirmo", "Compra": "A compra|A reposição|A entrega", "pastas": "pastas|caixas|resmas", "refoge": "refoge a este feito de|nada tem com este feito de",
    "Requisita": "Requisita-se|Solicita-se|Pede-se", "Este": "Este traslado|O presente documento|Esta cópia|O conteúdo desta página|Este expediente|A presente peça", "vale": "perde o efeito se rasurado conforme aviso afixado na|dispensa carimbo da unidade e integra o acervo da|pode conter dados sigilosos e deve ser devolvido à|foi convertido por sistema automático nos termos do regimento da|destina-se apenas ao uso interno conforme aviso afixado na|tem validade somente no território da comarca nos termos do regimento da|não substitui a certidão original da unidade de",
    "Short": "Oficie-se.|Junte-se.|P. R. I.|À conclusão.|Defiro.|Cumpra-se.|Publique-se. Intimem-se.|É o relatório.|Ciência às partes.|Dê-se baixa.|Nada mais havendo, lavrei a presente.|Aguarde-se em secretaria.|Expedientes necessários.|Voltem-me conclusos.|Vista às partes.|Certifique-se.|Decido.",
}


class Table:
    """Fills frames; `row` gives (text, [(start, end, kind)])."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return self.pick(_ON) + self.pick(_MID) + self.pick(_OFF)

    def surname(self) -> str:
        x = self.r.random()
        return self.word() if x < 0.8 else self.pick(FAMILY) if x < 0.92 else (self.pick(_FOREIGN) + self.pick(_FOREIGN_END)).capitalize()

    def given(self) -> str:
        x = self.r.random()
        return self.pick(GIVEN) if x < 0.88 else self.pick(ABROAD) if x < 0.95 else self.pick(_ON) + self.pick("ela ane iel ino ilda aldo ana eth son ton ia ete".split())

    def small(self) -> str:
        """A word of no meaning in small letters."""
        return (self.pick(_ON) + self.pick(_MID) + self.pick("ar er ir a o e as os ou eu ia ava mente cao ndo".split())).lower()

    def trade(self) -> str:
        """A trade, now and then one made up: who does it, and of what."""
        if self.r.random() < 0.75:
            return self.pick(TRADES)
        of = self.pick(_ON) + self.pick(_MID) + self.pick("ia ica ura gem s cao dade or ista".split())
        return f"{self.pick('Técnico Perito Analista Especialista Engenheiro Tradutor Historiador Intérprete Avaliador Mestre Instrutor Corretor'.split())} {self.pick(['de', 'da', 'em', 'e', 'do', ''])} {of}".replace("  ", " ")

    def loosened(self, frame: str) -> str:
        """A frame with a word here and there replaced by one of no meaning, so that the model doesn't lean on single words."""
        return re.sub(r"(?<![{\w])[a-záéíóúâêôãõç]{4,}(?![\w}])", lambda m: self.small() if self.r.random() < 0.1 else m.group(), frame)

    def name(self) -> str:
        given = [self.given()] + ([self.given()] if self.r.random() < 0.3 else [])
        mid = [self.pick(_ON) + self.pick(_MID) + self.pick(_OFF_MID) if self.r.random() < 0.85 else self.surname()] if self.r.random() < 0.72 else []
        particle = [self.pick(["de", "da", "do", "dos", "das"])] if self.r.random() < 0.4 else []
        last = [self.surname()]
        suffix = [self.pick(["Filho", "Júnior", "Neto", "Jr."])] if self.r.random() < 0.08 else []
        x = self.r.random()
        if x < 0.12:
            given = [given[0][0] + "."]
        elif x < 0.2 and mid:
            mid = [mid[0][0] + "."]
        elif x < 0.32:
            out = f"{last[0].upper() if self.r.random() < 0.6 else last[0]}{' ' + mid[0] if mid and self.r.random() < 0.4 else ''}, {' '.join(given + ([] if self.r.random() < 0.4 else mid))}"
            return out.upper() if self.r.random() < 0.2 else out
        parts = given + mid + particle + last + suffix
        out = " ".join(parts)
        x = self.r.random()
        if x < 0.18:
            out = out.upper()
        elif x < 0.31:
            out = out.lower()
        elif x < 0.37:
            out = out.translate(str.maketrans("áàâãéêíóôõúç" + "ÁÉÍÓÂÊÔ", "aaaaeeiooouc" + "AEIOAEO"))
        if self.r.random() < 0.06:
            i = self.r.randrange(1, len(out))
            out = out[:i] + self.pick("0lc1aeirnS") + out[i + 1 :] if out[i].isalpha() else out
        return out

    def slip(self, s: str) -> str:
        """Now and then a digit read as a letter."""
        if self.r.random() < 0.12:
            at = [i for i, c in enumerate(s) if c in "01458"]
            if at:
                i = self.pick(at)
                s = s[:i] + {"0": "O", "1": self.pick("lI"), "4": "A", "5": "S", "8": "B"}[s[i]] + s[i + 1 :]
        return s

    def cpf(self) -> str:
        d = self.digits(11)
        a, b, c, e = d[:3], d[3:6], d[6:9], d[9:]
        return self.slip(self.pick([f"{a}.{b}.{c}-{e}"] * 6 + [d, d, f"{a} {b} {c} {e}", f"{a}{b}{c}-{e}", f"{a}.{b}.{c}/{e}", f"{a}. {b}.{c} - {e}"]))

    def rg(self) -> str:
        d = self.digits(8)
        return self.slip(self.pick([f"{d[0]}.{d[1:4]}.{d[4:7]}", d[:7], f"{d[0]}.{d[1:4]}.{d[4:7]}-{d[7]}", f"{d[:2]}.{d[2:5]}.{d[5:8]}"]))

    def pis(self) -> str:
        d = self.digits(11)
        return self.slip(self.pick([f"{d[:3]}.{d[3:8]}.{d[8:10]}-{d[10]}", d]))

    def phone(self) -> str:
        a, m, f = self.digits(2), "9" + self.digits(4), self.digits(4)
        p = self.pick("11123456789") + self.digits(3)
        return self.pick([f"({a}) {m}-{f}", f"({a}){p}-{f}", f"0{a} {p} {f}", f"{a} {m}.{f}", f"+55 {a} {m} {f}", f"( {a} ) 9 {m[1:]} - {f}", f"{a}{m}{f}", f"{a}{m}{f}", f"{m}-{f}", f"({a}) {p}-{f}", f"{a} {m}-{f}", f"{a} {p}-{f}"])

    def email(self) -> str:
        g, w = self.pick(GIVEN).lower(), self.word().lower()
        for x, y in zip("áàâãéêíóôõúç", "aaaaeeiooouc"):
            g, w = g.replace(x, y), w.replace(x, y)
        user = self.pick([f"{g}.{w}", f"{g}{self.digits(2)}", f"{g[0]}{w}", f"{w}_{g}", f"{g}-{w}", f"{w}.pericias", f"{w}.{g}"])
        host, end = self.pick(["correio", "mail", "exemplo", "laudos", self.word().lower(), f"{self.word().lower()}-{self.word().lower()}", f"mail.{self.word().lower()}"]), self.pick(ENDS)
        out = self.pick([f"{user}@{host}.{end}"] * 7 + [f"{user}(at){host}.{end}", f"{user} [arroba] {host}.{end}", f"{user} arroba {host} ponto {end}", f"{user} arroba {host} ponto {end}", f"{user} @ {host}.{end}", f"{user}@ {host} . {end}"])
        return out.upper() if self.r.random() < 0.07 else out

    def address(self) -> str:
        kind = self.pick(STREET)
        x = self.r.random()
        if x < 0.2:
            return f"{self.pick('Beco Sítio Loteamento Conjunto Condomínio Quadra Fazenda Vila Qd. Cond. Conj. Lot.'.split())} {self.digits(2)} Lt. {self.digits(2)}, nº {self.digits(4)}"
        title = self.pick(["Padre", "Coronel", "Conselheiro", "Dona " + self.pick(GIVEN), "Dona " + self.word(), "Doutor", "Barão de", "", "", ""])
        body = self.pick([self.pick(STREET_NAMES), self.pick(STREET_NAMES), self.pick(FAMILY), f"dos {self.small()}s".title().replace("Dos", "dos"), f"das {self.word()}s {self.word()}s", f"{self.word()} e {self.word()} de {self.pick(MONTHS).title()}", f"{title} {self.word()}".strip(), f"{title} {self.word()}".strip(), f"da {self.word()}", f"{self.word()} Norte", f"{self.word()} Velho", f"dos {self.word()}s", f"{title} {self.word()} I".strip(), f"do {self.word()} II", f"do {self.word()} do Alto"])
        number = self.pick([", {n}", " {n}", ", nº {n}", ", n. {n}", ", n.º {n}, apto {m}", ", {n}, bloco B", ", s/n", ", km {k}", ", n.º {n}", ", {n}, apto {m}", ", casa {k}", ", quadra {k}, lote {k}", ", casa {k}"]).format(n=self.digits(self.pick([2, 3, 4])), m=self.digits(3), k=self.digits(2))
        return f"{kind} {body}{number}"

    def plain(self, slot: str) -> str:
        n = self.digits
        if slot in PLAIN:
            return self.pick(PLAIN[slot].split("|"))
        date = self.pick([f"{n(2)}/{n(2)}/20{n(2)}", f"{self.r.randrange(1, 29)} de {self.pick(MONTHS)} de 20{n(2)}", f"{n(2)}.{n(2)}.{n(2)}"])
        place = f"{self.pick(PLACES)} {self.pick([self.pick(PLACE_ENDS), self.word(), 'd' + self.pick(['a', 'o', 'as', 'os']) + ' ' + self.word(), 'do ' + self.word() + self.pick([' Velho', ' Novo'])])}"
        court = f"{n(1)}ª {self.pick(['Vara Cível', 'Vara da Fazenda', 'Vara Mista', 'Secretaria', 'Câmara'])} de {place} {self.word()}"
        firm = f"{self.pick(FIRMS)} {self.word()}{self.pick([' Ltda.', ' S.A.', '', ' S/A'])}"
        return {
            "t": self.pick(["", "", "", "", "", "Sr. ", "Sra. ", "Dr. ", "Dra. ", "o Sr. ", "a Sra. "]), "trade": self.trade(), "date": date, "place": place, "court": court if self.r.random() < 0.8 else f"{n(1)}ª Vara ({self.word()})", "COURT": court.upper(), "firm": firm,
            "n": str(self.r.randrange(1, 60)), "d": n(1), "nn": n(2), "nnn": n(3), "nnnn": n(4), "nnnnn": n(5), "year": "20" + n(2), "hour": f"{self.r.randrange(24)}h{n(2)}", "money": f"R$ {n(3)},{n(2)}" if self.r.random() < 0.7 else f"R$ {n(1)}.{n(3)},{n(2)}",
            "proc": f"{n(7)}-{n(2)}.20{n(2)}.8.98.{n(4)}", "padm": f"20{n(2)}.{n(2)}.{n(7)}", "cnpj": f"{n(2)}.{n(3)}.{n(3)}/000{n(1)}-{n(2)}", "proto": self.pick([n(11), f"{n(9)}-{n(1)}"]), "hex": "".join(self.pick("0123456789ABCDEF") for _ in range(8)),
            "word": self.word(), "word2": self.small(), "words": f"{self.small()} {self.small()}", "years": n(2), "low": self.word().lower(), "STATE": self.word().upper(), "building": f"{self.pick(GIVEN)} {self.word()}",
        }[slot]

    def fill(self, frame: str, spans: list, at: int) -> str:
        out, i = [], 0
        while i < len(frame):
            if frame[i] == "{":
                j = frame.index("}", i)
                slot = frame[i + 1 : j]
                if slot in KINDS:
                    s = getattr(self, slot)()
                    spans.append((at, at + len(s), slot))
                else:
                    s = self.plain(slot)
                    if "{" in s:
                        s = self.fill(s, [], 0)
                i = j + 1
            else:
                s, i = frame[i], i + 1
            out.append(s)
            at += len(s)
        return "".join(out)

    def row(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A page of a few sentences, with lines broken at some width; or a field's value."""
        spans: list[tuple[int, int, str]] = []
        if self.r.random() < 0.3:
            # a bare number of eleven digits in such a field is a tax number, not a telephone
            while True:
                spans = []
                text = self.fill(self.pick(VALUES), spans, 0)
                if not any(kind == "phone" and text[a:b].isdigit() for a, b, kind in spans):
                    return text, spans
        text = ""
        for _ in range(self.r.randrange(2, 5)):
            if text:
                text += self.pick([" ", "\n", "\n", "\n\n"])
            new = self.fill(self.loosened(self.pick(FRAMES if self.r.random() < 0.85 else OTHER_FRAMES)), spans, len(text))
            text += new.upper() if self.r.random() < 0.05 and len(new.upper()) == len(new) else new
        width = self.pick([0, 60, 80, 100])
        if width:
            chars, last = list(text), 0
            for i, c in enumerate(chars):
                if c == "\n":
                    last = i
                elif c == " " and i - last > width:
                    chars[i], last = "\n", i
            text = "".join(chars)
        return text, spans


def labelled(rows: int = 2400, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The table: texts with the places and kinds of their items."""
    table = Table(seed)
    return [table.row() for _ in range(rows)]
